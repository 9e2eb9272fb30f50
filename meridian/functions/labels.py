"""Dates and places in labels: listings, captions, page dates, month names of two languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions.dates import MONTHS

# Dutch names of months that are not the English ones, by number; words that say when in a month.
DUTCH = {"januari": 1, "februari": 2, "maart": 3, "mei": 5, "juni": 6, "juli": 7, "augustus": 8, "oktober": 10}
WHEN = "early|mid|late|about|circa"


def month_of(token: Column, page: Column) -> Column:
    """Number of a month named in English or Dutch, or by a beginning that only one English month has; of several, the one that the page's name begins with."""
    low = F.lower(F.trim(token))
    named = F.coalesce(*(F.when(low == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)), *(F.when(low == m, F.lit(i)) for m, i in DUTCH.items()))
    begun = F.filter(F.array(*(F.when((low != "") & F.lit(m).startswith(low), F.lit(i + 1)) for i, m in enumerate(MONTHS))), lambda m: m.isNotNull())
    name = F.lower(F.regexp_extract(page, r"([^/?#]*)(?:[?#].*)?$", 1))
    on_page = F.filter(F.array(*(F.when(name.startswith(m), F.lit(i + 1)) for i, m in enumerate(MONTHS))), lambda m: m.isNotNull())
    both = F.array_intersect(begun, on_page)
    return F.coalesce(named, F.when(F.size(begun) == 1, F.get(begun, F.lit(0))), F.when(F.size(both) == 1, F.get(both, F.lit(0))))


def page_date(x: Column, year: Column) -> Column:
    """YYYY-MM-DD of dd-mm-yyyy, or YYYY-MM of a month's name and year, if the year is the page's; else null."""
    text = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^[ .]+|[ .]+$", "")
    full, named = r"^(\d{1,2})-(\d{1,2})-(\d{4})$", r"^([A-Za-z]+) (\d{4})$"
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    month = F.coalesce(*(F.when(F.lower(F.regexp_extract(text, named, 1)) == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    return F.coalesce(
        F.when((part(full, 3) == year) & part(full, 2).between(1, 12) & part(full, 1).between(1, 31), F.format_string("%04d-%02d-%02d", part(full, 3), part(full, 2), part(full, 1))),
        F.when((part(named, 2) == year) & month.isNotNull(), F.format_string("%04d-%02d", part(named, 2), month)),
    )


def capture_date(taken: Column, title: Column) -> Column:
    """(date, precision, origin) of a picture: a title's approximate year, or else the first of its metadata and then its title that has a whole date, year first or last, or a year."""
    about = F.regexp_extract(title, r"(?i)\bc\.?\s*(19\d{2}|20\d{2})\b", 1)
    ymd, dmy, year = r"(?<!\d)(\d{4})[-:/.](\d{2})[-:/.](\d{2})(?!\d)", r"(?<!\d)(\d{2})[-:/.](\d{2})[-:/.](\d{4})(?!\d)", r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"
    out = lambda when, date, precision, origin: F.when(when, F.struct(date.alias("date"), F.lit(precision).alias("precision"), F.lit(origin).alias("origin")))
    part = lambda x, p, i: F.regexp_extract(x, p, i)
    tries = [out(about != "", about, "year", "title_about")]
    for x, origin in ((taken, "metadata"), (title, "title")):
        tries += [
            out(part(x, ymd, 1) != "", F.concat_ws("-", part(x, ymd, 1), part(x, ymd, 2), part(x, ymd, 3)), "day", origin), out(part(x, dmy, 1) != "", F.concat_ws("-", part(x, dmy, 3), part(x, dmy, 2), part(x, dmy, 1)), "day", origin),
            out(part(x, year, 1) != "", part(x, year, 1), "year", origin),
        ]
    return F.coalesce(*tries, F.struct(F.lit("").alias("date"), F.lit("unknown").alias("precision"), F.lit("").alias("origin")))


def dated_place(line: Column) -> Column:
    """(year, month, day, qualifier, place) of a line such as ``1990 July 12 early Ashbold Down``; null without a year. Days are not checked against the calendar."""
    names = "|".join(m.capitalize() for m in MONTHS)
    shape = rf"^\s*((?:19|20)\d\d)\b\s*(?:({names})\b\s*(?:(\d{{1,2}})\b)?)?\s*(?:\b({WHEN})\b)?\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract(line, shape, i)
    month = F.coalesce(*(F.when(F.lower(part(2)) == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    return F.when(line.rlike(shape), F.struct(part(1).cast("int").alias("year"), month.alias("month"), part(3).try_cast("int").alias("day"), part(4).alias("qualifier"), part(5).alias("place")))


# The forms of index lines, each with the groups that hold place, region, country, day, month and year.
_MONTH = "(" + "|".join(m.capitalize() for m in MONTHS) + ")"
LISTINGS = {
    "season": (rf"^([^,]+), (?:([^,]+), )?([^,.]+)\. Reported (\d{{1,2}}) {_MONTH}\.$", (1, 2, 3, 4, 5, 0)),
    "table": (r"^([^,]+)(?:, ([^,]+))?, (\d{4})-(\d{2})(?:-(\d{2}))?$", (1, 2, 0, 5, 4, 3)),
    "year": (rf"^(?:(\d{{1,2}}) )?{_MONTH} (\d{{4}}) - (.+)$", (4, 0, 0, 1, 2, 3)),
    "report": (rf"^Reported (?:(\d{{1,2}}) )?{_MONTH}, (.+)$", (3, 0, 0, 1, 2, 0)),
}


def listing(line: Column) -> Column:
    """(form, place, region, country, day, month, year) of an index line in one of four forms; what a form lacks is null, a line of none is null."""

    def one(form: str) -> Column:
        pattern, groups = LISTINGS[form]
        text = [F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) if g else F.lit(None).cast("string") for g in groups]
        month = F.coalesce(text[4].try_cast("int"), *(F.when(F.lower(text[4]) == m, F.lit(i + 1)) for i, m in enumerate(MONTHS)))
        fields = {"form": F.lit(form), "place": text[0], "region": text[1], "country": text[2], "day": text[3].try_cast("int"), "month": month, "year": text[5].try_cast("int")}
        return F.when(line.rlike(pattern), F.struct(*(c.alias(n) for n, c in fields.items())))

    return F.coalesce(*map(one, LISTINGS))
