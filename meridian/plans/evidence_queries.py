"""Queries of what is read out of labels, addresses, texts, pages and nested values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import coords, labels
from meridian.functions.text import listed, normal, unescaped
from meridian.operators import cascade, geometry, records
from meridian.runtime import table
from meridian.sources import html

_GOOD = "abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT isnan(latitude) AND NOT isnan(longitude)"
# Keys that no input may hold; names of countries in other words; what a page's path says of its role.
FORBIDDEN = ("ground_truth", "final_coordinate", "final_coordinates", "evaluator_only")
COUNTRIES = {"england": "GB", "united kingdom": "GB", "scotland": "GB", "wales": "GB", "holland": "NL", "netherlands": "NL", "deutschland": "DE", "germany": "DE", "usa": "US", "united states": "US", "france": "FR", "nippon": "JP", "japan": "JP", "switzerland": "CH", "italy": "IT", "spain": "ES", "canada": "CA", "sweden": "SE", "poland": "PL"}
ROLES = [(r"/annex/", "annex"), (r"/historical/", "historical"), (r"/byyear/\d{4}/", "year_page"), (r"/reports/\d{4}/", "report"), (r"index-\d+", "index")]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "legacy_kml_candidate_queue").where(f"{_GOOD} AND legacy_candidate_id IS NOT NULL").groupBy(F.col("legacy_candidate_id").alias("id")).agg(F.min(F.struct("latitude", "longitude")).alias("p")).select("id", F.round("p.latitude", 5).alias("y"), F.round("p.longitude", 5).alias("x"), (F.length("id") * 7 + F.ascii(F.substring("id", 9, 1)) + F.ascii(F.substring("id", 12, 1))).alias("k"))


def map_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and their uncertainty out of map links of six forms, made from the placemarks."""
    y, x = F.format_string("%.5f", "y"), F.format_string("%.5f", "x")
    forms = [F.concat(F.lit("https://www.google.com/maps/@"), y, F.lit(","), x, F.lit(",17z")), F.concat(F.lit("https://www.google.com/maps/@"), y, F.lit(","), x, F.lit(",812m/data=1")), F.concat(F.lit("https://maps.google.com/?q="), y, F.lit("%2C+"), x, F.lit("&z=4")),
             F.concat(F.lit("https://www.google.com/maps/place/x/data=!3d"), y, F.lit("!4d"), x), F.concat(F.lit("https://maps.google.com/?ll="), y, F.lit(","), x), F.concat(F.lit("https://elsewhere.example/@"), y, F.lit(","), x, F.lit(",9z"))]
    rows = _marks(spark, sf_dir).withColumn("url", F.element_at(F.array(*forms), (F.col("k") % 6 + 1).cast("int"))).withColumn("m", coords.map_link(F.col("url")))
    return rows.select("id", "url", F.round("m.lat", 5).alias("lat"), F.round("m.lon", 5).alias("lon"), "m.method", "m.uncertainty_m")


def angle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions out of degrees, minutes and seconds, made from the placemarks."""
    part = lambda c: (F.floor(F.abs(c)).cast("int"), F.floor(F.abs(c) * 60 % 60).cast("int"))
    (d, m), (e, n) = part(F.col("y")), part(F.col("x"))
    text = F.concat(F.format_string("%d°%d'%.1f\"", d, m, (F.col("k") % 60).cast("double")), F.when(F.col("y") < 0, "S").otherwise("N"), F.lit(" "), F.format_string("%d°%d'%.1f\"", e, n, (F.col("k") % 47).cast("double")), F.when(F.col("x") < 0, "W").otherwise("E"))
    return _marks(spark, sf_dir).withColumn("p", coords.dms_pair(text)).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def grid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eastings and northings out of links to a British map, pointers and references, made from parts."""
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://www.streetmap.co.uk/map?x="), (k * 131 % 600000).cast("string"), F.lit("&y="), (k * 77 % 900000).cast("string"))).when(k % 3 == 1, F.concat(F.lit("http://streetmap.co.uk/?sv=SU"), F.format_string("%04d%04d", k * 7 % 10000, k * 13 % 10000))).otherwise(F.lit("http://elsewhere.example/?x=1&y=2"))
    rows = table(spark, sf_dir, "part").withColumn("g", coords.grid_link(url))
    east, north, unit = geometry.grid_reference(F.col("g.reference"))
    return rows.select("p_partkey", F.coalesce("g.easting", east).alias("easting"), F.coalesce("g.northing", north).alias("northing"), F.when(F.col("g.easting").isNull() & unit.isNotNull(), F.greatest(F.lit(25.0), unit)).when(F.col("g.easting").isNotNull(), F.lit(25.0)).alias("uncertainty_m"))


def text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that texts tell in labelled degrees or in degrees and minutes, made from the placemarks."""
    y, x, k = F.format_string("%.5f", F.abs("y")), F.format_string("%.5f", F.abs("x")), F.col("k")
    ways = F.when(F.col("y") < 0, "S").otherwise("N"), F.when(F.col("x") < 0, "W").otherwise("E")
    minutes = lambda c: F.concat(F.floor(F.abs(c)).cast("string"), F.lit("° "), F.format_string("%.5f", F.abs(c) * 60 % 60), F.lit("' "))
    text = F.when(k % 3 == 0, F.concat(F.lit("Found at latitude: "), y, F.lit("° "), ways[0], F.lit(", longitude: "), x, F.lit("° "), ways[1], F.lit(" by walkers"))).when(k % 3 == 1, F.concat(F.lit("At "), minutes(F.col("y")), ways[0], F.lit(" and "), minutes(F.col("x")), ways[1], F.lit(" they lay"))).otherwise(F.lit("nowhere in particular, lat unknown"))
    return _marks(spark, sf_dir).withColumn("p", coords.text_position(text)).select("id", F.round("p.lat", 5).alias("lat"), F.round("p.lon", 5).alias("lon"), "p.method")


def position_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each map file's placemarks the different positions, to a thousandth of a degree, with the first placemark there."""
    rows = table(spark, sf_dir, "legacy_kml_candidate_queue").where(f"{_GOOD} AND original_kml_sha256 <> '' AND legacy_candidate_id IS NOT NULL").select("original_kml_sha256", "legacy_candidate_id", "latitude", "longitude")
    return coords.distinct_positions(rows, ["original_kml_sha256"], "latitude", "longitude", [F.col("legacy_candidate_id"), F.col("latitude"), F.col("longitude")], 1e-3).groupBy("original_kml_sha256").agg(F.count("*").alias("positions"), F.min("legacy_candidate_id").alias("first_id"))


def listing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, region, country and date out of index lines of four forms; which form, and whether it agrees with what was parsed before."""
    rows = table(spark, sf_dir, "source_assertions").where("source_listing_text IS NOT NULL").select("assertion_id", "source_listing_text", "month").distinct()
    p = labels.listing(F.col("source_listing_text"))
    return rows.withColumn("l", p).select("assertion_id", "l.form", "l.place", "l.region", "l.country", "l.day", F.col("l.month").alias("told_month"), "l.year", F.coalesce(F.col("l.month") == F.col("month"), F.lit(False)).alias("agrees")).distinct()


def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines of each source: how many, how many are read, and what keeps the others out."""
    rows = table(spark, sf_dir, "source_assertions").select("source_name", "assertion_id", "source_listing_text").distinct()
    why = F.when(F.coalesce("source_listing_text", F.lit("")) == "", "no line").when(labels.listing(F.col("source_listing_text")).isNull(), "no form").otherwise("read")
    return rows.groupBy("source_name", why.alias("outcome")).agg(F.count("*").alias("n"))


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in a page's own year, as numbers or by month, made from the formations; others are none."""
    rows = table(spark, sf_dir, "formations").where("day IS NOT NULL").select("formation_id", "year", "month", "day").distinct()
    text = F.when(F.col("day") % 3 == 0, F.format_string(" %d-%d-%d. ", "day", "month", "year")).when(F.col("day") % 3 == 1, F.concat(F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM"), F.lit("  "), F.col("year").cast("string"))).otherwise(F.format_string("%d-%d-%d", "day", "month", F.col("year") + 1))
    return rows.select("formation_id", "year", "month", "day", labels.page_date(text, F.col("year")).alias("told"))


def month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months by English and Dutch names and beginnings, with a page's name deciding between two."""
    words = ["jan", "ju", "juni", "Mei", "ma", "sept", "oktober", "x", "augustus", "d", "j", "a", ""]
    k = F.col("p_partkey")
    token, page = F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("http://p.example/july2003.html", "http://p.example/index.html", "http://p.example/a/march-list?x=1"))), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.month_of(token, page).alias("month"))


def capture_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of pictures out of metadata and titles, made from their records."""
    rows = table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_assertion_id", F.coalesce("date_iso", F.lit("")).alias("d"), F.coalesce("place", F.lit("")).alias("p")).distinct()
    k = F.length("p") % 4
    title = F.when(k == 0, F.concat("p", F.lit(" c. "), F.substring("d", 1, 4))).when(k == 1, F.concat("p", F.lit(" 2001:02:03.jpg"))).otherwise(F.concat(F.lit("File 07.08.1999 "), "p"))
    taken = F.when(k == 2, F.concat("d", F.lit(" 12:00"))).otherwise(F.lit(""))
    return rows.withColumn("c", labels.capture_date(taken, title)).select("commons_assertion_id", F.col("d").alias("had"), F.length("p").alias("length"), "c.date", "c.precision", "c.origin").distinct()


def dated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, month, day, qualifier and place out of lines such as catalogues have, made from the formations."""
    rows = table(spark, sf_dir, "formations").where("place <> ''").select("formation_id", "year", "month", "day", "place").distinct()
    month = F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM")
    k = F.length("place") % 3
    line = F.when(k == 0, F.concat_ws(" ", F.col("year").cast("string"), month, F.col("day").cast("string"), "place")).when(k == 1, F.concat_ws(" ", F.col("year").cast("string"), month, F.lit("early"), "place")).otherwise(F.concat_ws(" ", F.col("year").cast("string"), "place"))
    return rows.withColumn("l", labels.dated_place(line)).select("formation_id", "l.year", "l.month", "l.day", "l.qualifier", "l.place").distinct()


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight different passages of each text about directions and about positions, and the priority that follows."""
    # The words alone are looked for first: most texts have none, and the window before a word is tried at every letter.
    passages = lambda words: F.when(F.col("text").rlike(rf"\b(?:{words})\b"), F.regexp_extract_all("text", F.lit(rf"[^\n]{{0,30}}\b(?:{words})\b[^\n]{{0,30}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    around = lambda words: F.slice(F.array_distinct(F.transform(passages(words), lambda s: F.trim(s))), 1, 8)
    rows = _texts(spark, sf_dir).select("doc_id", around("axis|bearing|azimuth|north|compass").alias("a"), around("latitude|longitude|coordinates|grid reference").alias("b")).distinct()
    rows = rows.where((F.size("a") > 0) | (F.size("b") > 0))
    return rows.select("doc_id", F.array_join("a", " || ").alias("orientation"), F.array_join("b", " || ").alias("coordinate"), F.when((F.size("a") > 0) & (F.size("b") > 0), "high").when(F.size("a") > 0, "medium").otherwise("coordinate_only").alias("priority"))


def forbidden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of forbidden keys, at whatever depth, in nested records made from events."""
    k = F.col("event_id")
    nested = F.concat(F.lit('{"a": [{"Ground_Truth": 1}, {"b": {"k": '), (k % 7).cast("string"), F.lit(', "'), F.when(k % 3 == 0, "final_coordinate").when(k % 3 == 1, "other").otherwise("EVALUATOR_ONLY"), F.lit('": [1, {"ok": 2}]}}], "c": '), F.col("props"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", nested.alias("record"))
    return forbidden(rows, "event_id", "record")


def forbidden(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, path) of every key of ``FORBIDDEN``, in whatever case, at any depth of JSON records; what is no JSON has none."""
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["r"]):
                try:
                    open_ = [("$", json.loads(text))]
                except (TypeError, ValueError, RecursionError):
                    continue
                while open_:
                    path, value = open_.pop()
                    below = [(f"{path}.{n}", v, n) for n, v in value.items()] if isinstance(value, dict) else [(f"{path}[{i}]", v, "") for i, v in enumerate(value)] if isinstance(value, list) else []
                    out += [(k, p) for p, _, n in below if n.lower() in FORBIDDEN]
                    open_ += [(p, v) for p, v, _ in below]
            yield pd.DataFrame(out, columns=["k", "path"])

    return rows.select(F.col(key).alias("k"), F.col(record).alias("r")).mapInPandas(walk, f"k {kind}, path string").withColumnRenamed("k", key)


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with their escapes resolved, addresses of one host in one form, and names that are safe as files."""
    rows = table(spark, sf_dir, "iccra_report_links_full").where("url IS NOT NULL").select("url").distinct()
    told = F.concat(F.regexp_replace("url", "^https?://reports", "HTTP://WWW.Reports"), F.lit("?a=1&amp;b=2#top"))
    host = F.regexp_replace(F.lower(F.regexp_extract(told, r"(?i)^https?://([^/?#]+)", 1)), r"^www\.", "")
    one = F.when(told.rlike("(?i)^https?://"), F.concat(F.lit("https://"), host, F.regexp_replace(F.regexp_extract(told, r"(?i)^https?://[^/?#]+([^#]*)", 1), "&amp;", "&")))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"([^/]*)$", 1), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return rows.select("url", one.alias("one_form"), unescaped(F.concat(F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1), F.lit("%20x"))).alias("path"), stem.alias("stem"), F.nullif(F.regexp_extract("url", r"(\d+)", 1).try_cast("long"), F.lit(0)).alias("first_number"))


def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the role that their path tells, the first rule counting; and whether the file is a picture, a document or a page."""
    role = F.coalesce(*(F.when(F.col("url").rlike(p), F.lit(r)) for p, r in ROLES), F.lit("other"))
    kind = F.when(F.col("url").rlike(r"(?i)\.(?:jpe?g|png|gif|tiff?)$"), "picture").when(F.col("url").rlike(r"(?i)\.(?:pdf|docx?)$"), "document").when(F.col("url").rlike(r"(?i)\.html?$"), "page").otherwise("other")
    return table(spark, sf_dir, "iccra_report_links_full").where("url IS NOT NULL").groupBy(role.alias("role"), kind.alias("kind")).agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"))


def country_from_parts(parts: Column) -> Column:
    """The code of the longest country name that ends the last part of a list, by whole words; null without."""
    last = F.coalesce(normal(F.element_at(parts, -1)), F.lit(""))
    names = sorted(COUNTRIES, key=lambda n: (-len(n), n))
    return F.coalesce(*(F.when((last == n) | last.endswith(" " + n), F.lit(COUNTRIES[n])) for n in names))


def country_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries out of the last part of what a record says of its place, against the code that it has."""
    rows = table(spark, sf_dir, "formations").select("formation_id", "country_code", F.concat_ws(", ", "place", "region", "country").alias("told")).distinct()
    found = rows.withColumn("found", country_from_parts(listed(F.col("told"), ",")))
    return found.groupBy("country_code", "found").agg(F.count("*").alias("n"))


def same_event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations and assertions of one date and country of which one's place is the other's, or its first words."""
    shape = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), "date_iso", "country_code", F.coalesce(normal(F.col("place")), F.lit("")).alias("p")).where("p <> ''").distinct()
    head = lambda c: F.substring_index(c, " ", 1)
    a = shape("formations", "formation_id").select(F.col("id").alias("a_id"), "date_iso", "country_code", F.col("p").alias("a_p"), head("p").alias("h"))
    b = shape("source_assertions", "assertion_id").select(F.col("id").alias("b_id"), "date_iso", "country_code", F.col("p").alias("b_p"), head("p").alias("h"))
    pairs = a.join(b, ["date_iso", "country_code", "h"])
    return pairs.where(cascade.likely_same(F.col("date_iso"), F.col("country_code"), F.col("a_p"), F.col("date_iso"), F.col("country_code"), F.col("b_p"))).select("a_id", "b_id").distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "iccra_report_links_full").where("url IS NOT NULL").groupBy("url").agg(F.max(F.length(F.coalesce("anchor_text", F.lit("")))).alias("n"))
    k = F.col("n") % 5
    body = F.concat(
        F.lit("<html><head><title> A  page </title><script>var x = '<a href=no>';</script></head><body><ul><li><a href='one.htm'>First &amp; best</a> <img src='/nav/back.gif' width=20 height=20><img src='pic1.jpg' width='"), (k * 100).cast("string"), F.lit("px' height=300><li><a href='/two.htm#x'>Second</a></ul><p><a href='three.htm'>Third<p><img src=pic2.jpg width=10 height=10>"),
        F.when(k > 2, "<img src='pic1.jpg' width=900 height=900>").otherwise(""), F.lit("</body></html>"),
    )
    return rows.select(F.concat(F.regexp_replace("url", "/[^/]*$", "/"), F.sha1("url"), F.lit(".htm")).alias("url"), "n", body.alias("body"))


def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's pictures, once each with the largest declared area, without those that serve navigation."""
    return html.page_images(html.parse_pages(_pages(spark, sf_dir), "url", "body")).select("url", F.regexp_extract("image", "([^/]*)$", 1).alias("image"), "area")


def link_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links with the picture in their cell, or else the next one."""
    rows = html.beside_links(html.parse_pages(_pages(spark, sf_dir), "url", "body"))
    return rows.select("url", F.regexp_extract("link", "([^/]*)$", 1).alias("link"), "text", F.regexp_extract("image", "([^/]*)$", 1).alias("image"))


def gazetteer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of every place: its own, its plain one and up to forty others, each once, with the first place that has it in its country."""
    rows = table(spark, sf_dir, "formations").groupBy("formation_id").agg(F.min(F.struct("place", "country_code", "region")).alias("f")).select("formation_id", "f.*").where("place <> ''")
    others = F.slice(listed(F.concat_ws(",", "region", F.regexp_replace("place", " ", ",")), ","), 1, 40)
    names = rows.select("formation_id", "country_code", F.explode(F.array_distinct(F.filter(F.transform(F.concat(F.array("place"), others), normal), lambda n: n != ""))).alias("name"))
    return records.best_by(names, ["country_code", "name"], [("first_id", F.col("formation_id"))], []).join(names.groupBy("country_code", "name").agg(F.count("*").alias("places")), ["country_code", "name"])


def footprint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes, made from orders, that overlap a search box and a span of days, the newest ten of each kind."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    scenes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("collection"), (k % 20 - 10).cast("double").alias("west"), (k % 13 + 40).cast("double").alias("south"), day.alias("first"), F.date_add(day, (k % 9).cast("int")).alias("last"))
    hits = scenes.where((F.col("west") <= 2.5) & (F.col("west") + 1.5 >= -1.0) & (F.col("south") <= 46) & (F.col("south") + 1.0 >= 44.5) & (F.col("first") <= F.lit("1996-12-31").cast("date")) & (F.col("last") >= F.lit("1995-01-01").cast("date")))
    from pyspark.sql import Window

    at = Window.partitionBy("collection").orderBy(F.desc("last"), "o_orderkey")
    return hits.withColumn("n", F.row_number().over(at)).where("n <= 10").select("collection", "o_orderkey", F.date_format("last", "yyyy-MM-dd").alias("last"), "n")


QUERIES = {f.__name__: f for f in (
    map_links, angle_pairs, grid_links, text_positions, position_candidates, listing_parts, parse_coverage, page_dates, month_names, capture_dates, dated_places, snippets, forbidden_paths, url_forms, page_roles, country_parts, same_event_names,
    page_pictures, link_pictures, gazetteer_names, footprint_search,
)}

_N = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
_MARKS = f"(SELECT id, round(p.latitude, 5) y, round(p.longitude, 5) x, length(id) * 7 + ascii(substr(id, 9, 1)) + ascii(substr(id, 12, 1)) k FROM (SELECT legacy_candidate_id id, min({{'latitude': latitude, 'longitude': longitude}}) p FROM legacy_kml_candidate_queue WHERE {_GOOD} AND legacy_candidate_id IS NOT NULL GROUP BY 1))"
_MONTHS = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_ANY = "|".join(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"))
_MO = (lambda x: f"list_position({_MONTHS}, {x})")
_LIST = f"""(SELECT DISTINCT assertion_id, source_name, source_listing_text t, month, regexp_matches(source_listing_text, '^([^,]+), (?:([^,]+), )?([^,.]+)\\. Reported (\\d{{1,2}}) ({_ANY})\\.$') f1, regexp_matches(source_listing_text, '^([^,]+)(?:, ([^,]+))?, (\\d{{4}})-(\\d{{2}})(?:-(\\d{{2}}))?$') f2,
  regexp_matches(source_listing_text, '^(?:(\\d{{1,2}}) )?({_ANY}) (\\d{{4}}) - (.+)$') f3, regexp_matches(source_listing_text, '^Reported (?:(\\d{{1,2}}) )?({_ANY}), (.+)$') f4 FROM source_assertions)"""
_R1, _R2 = f"'^([^,]+), (?:([^,]+), )?([^,.]+)\\. Reported (\\d{{1,2}}) ({_ANY})\\.$'", "'^([^,]+)(?:, ([^,]+))?, (\\d{4})-(\\d{2})(?:-(\\d{2}))?$'"
_R3, _R4 = f"'^(?:(\\d{{1,2}}) )?({_ANY}) (\\d{{4}}) - (.+)$'", f"'^Reported (?:(\\d{{1,2}}) )?({_ANY}), (.+)$'"
_CASE = (lambda a, b, c, d: f"nullif(CASE WHEN f1 THEN {a} WHEN f2 THEN {b} WHEN f3 THEN {c} WHEN f4 THEN {d} END, '')")
_X = (lambda r, g: f"regexp_extract(t, {r}, {g})")
_PAGE = "(SELECT regexp_replace(url, '/[^/]*$', '/') || sha1(url) || '.htm' AS url, max(length(coalesce(anchor_text, ''))) % 5 AS k FROM iccra_report_links_full WHERE url IS NOT NULL GROUP BY url)"
_WORDS = "['jan', 'ju', 'juni', 'Mei', 'ma', 'sept', 'oktober', 'x', 'augustus', 'd', 'j', 'a', '']"
SQL = {
    "map_links": f"""WITH m AS (SELECT *, printf('%.5f', y) sy, printf('%.5f', x) sx, k % 6 f FROM {_MARKS})
SELECT id, CASE f WHEN 0 THEN 'https://www.google.com/maps/@' || sy || ',' || sx || ',17z' WHEN 1 THEN 'https://www.google.com/maps/@' || sy || ',' || sx || ',812m/data=1' WHEN 2 THEN 'https://maps.google.com/?q=' || sy || '%2C+' || sx || '&z=4' WHEN 3 THEN 'https://www.google.com/maps/place/x/data=!3d' || sy || '!4d' || sx WHEN 4 THEN 'https://maps.google.com/?ll=' || sy || ',' || sx ELSE 'https://elsewhere.example/@' || sy || ',' || sx || ',9z' END AS url,
 CASE WHEN f < 5 THEN round(y, 5) END AS lat, CASE WHEN f < 5 THEN round(x, 5) END AS lon, ['google_maps_view_center_review_needed', 'google_maps_satellite_view_center', 'google_maps_query_coordinate', 'google_maps_place_target', 'google_maps_query_coordinate', NULL][f + 1] AS method, [100, 203, 25, 25, 25, NULL][f + 1] AS uncertainty_m FROM m""",
    "angle_pairs": f"""SELECT id, round((floor(abs(y)) + floor(abs(y) * 60 % 60) / 60 + (k % 60) / 3600) * CASE WHEN y < 0 THEN -1 ELSE 1 END, 6) AS lat, round((floor(abs(x)) + floor(abs(x) * 60 % 60) / 60 + (k % 47) / 3600) * CASE WHEN x < 0 THEN -1 ELSE 1 END, 6) AS lon FROM {_MARKS}""",
    "grid_links": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey * 131 % 600000 <> 0 AND p_partkey * 77 % 900000 <> 0 THEN (p_partkey * 131 % 600000)::double END WHEN 1 THEN 400000.0 + (p_partkey * 7 % 10000) * 10 + 5 END AS easting, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey * 131 % 600000 <> 0 AND p_partkey * 77 % 900000 <> 0 THEN (p_partkey * 77 % 900000)::double END WHEN 1 THEN 100000.0 + (p_partkey * 13 % 10000) * 10 + 5 END AS northing,
 CASE WHEN p_partkey % 3 = 1 OR (p_partkey % 3 = 0 AND p_partkey * 131 % 600000 <> 0 AND p_partkey * 77 % 900000 <> 0) THEN 25.0::double END AS uncertainty_m FROM part""",
    "text_positions": f"""WITH m AS (SELECT *, abs(y) ay, abs(x) ax, sign(y) s, sign(x) t FROM {_MARKS}), v AS (SELECT *, floor(ay) + round(ay * 60 % 60, 5) / 60 dy, floor(ax) + round(ax * 60 % 60, 5) / 60 dx, round(ay * 60 % 60, 5) < 60 AND round(ax * 60 % 60, 5) < 60 ok FROM m)
SELECT id, CASE k % 3 WHEN 0 THEN round(y, 5) WHEN 1 THEN CASE WHEN ok AND dy <= 90 AND dx <= 180 THEN round(CASE WHEN y < 0 THEN -dy ELSE dy END, 5) END END AS lat, CASE k % 3 WHEN 0 THEN round(x, 5) WHEN 1 THEN CASE WHEN ok AND dy <= 90 AND dx <= 180 THEN round(CASE WHEN x < 0 THEN -dx ELSE dx END, 5) END END AS lon,
 CASE k % 3 WHEN 0 THEN 'source_decimal_degrees' WHEN 1 THEN CASE WHEN ok AND dy <= 90 AND dx <= 180 THEN 'source_degree_decimal_minutes_converted' END END AS method FROM v""",
    "position_candidates": f"SELECT original_kml_sha256, count(DISTINCT (round(latitude / 1e-3), round(longitude / 1e-3))) AS positions, min(legacy_candidate_id) AS first_id FROM legacy_kml_candidate_queue WHERE {_GOOD} AND original_kml_sha256 <> '' AND legacy_candidate_id IS NOT NULL GROUP BY 1",
    "listing_parts": f"""WITH p AS (SELECT assertion_id, month, CASE WHEN f1 THEN 'season' WHEN f2 THEN 'table' WHEN f3 THEN 'year' WHEN f4 THEN 'report' END AS form, {_CASE(_X(_R1, 1), _X(_R2, 1), _X(_R3, 4), _X(_R4, 3))} AS place, {_CASE(_X(_R1, 2), _X(_R2, 2), "''", "''")} AS region, {_CASE(_X(_R1, 3), "''", "''", "''")} AS country,
 try_cast({_CASE(_X(_R1, 4), _X(_R2, 5), _X(_R3, 1), _X(_R4, 1))} AS int) AS day, CASE WHEN f1 THEN {_MO(_X(_R1, 5))} WHEN f2 THEN try_cast({_X(_R2, 4)} AS int) WHEN f3 THEN {_MO(_X(_R3, 2))} WHEN f4 THEN {_MO(_X(_R4, 2))} END AS told_month, try_cast({_CASE("''", _X(_R2, 3), _X(_R3, 3), "''")} AS int) AS year FROM {_LIST} WHERE t IS NOT NULL)
SELECT DISTINCT assertion_id, form, place, region, country, day, told_month, year, coalesce(told_month = month, false) AS agrees FROM p""",
    "parse_coverage": f"SELECT source_name, outcome, count(*) AS n FROM (SELECT DISTINCT source_name, assertion_id, t, CASE WHEN coalesce(t, '') = '' THEN 'no line' WHEN f1 OR f2 OR f3 OR f4 THEN 'read' ELSE 'no form' END AS outcome FROM {_LIST}) GROUP BY 1, 2",
    "page_dates": "SELECT DISTINCT formation_id, year, month, day, CASE day % 3 WHEN 0 THEN printf('%04d-%02d-%02d', year, month, day) WHEN 1 THEN printf('%04d-%02d', year, month) END AS told FROM formations WHERE day IS NOT NULL",
    "month_names": f"""WITH w AS (SELECT p_partkey, {_WORDS}[p_partkey % 13 + 1] t, ['july', '', 'march'][p_partkey % 3 + 1] pg FROM part)
SELECT p_partkey, CASE t WHEN 'jan' THEN 1 WHEN 'ju' THEN CASE WHEN pg = 'july' THEN 7 END WHEN 'juni' THEN 6 WHEN 'Mei' THEN 5 WHEN 'ma' THEN CASE WHEN pg = 'march' THEN 3 END WHEN 'sept' THEN 9 WHEN 'oktober' THEN 10 WHEN 'augustus' THEN 8 WHEN 'd' THEN 12 WHEN 'j' THEN CASE WHEN pg = 'july' THEN 7 END END AS month FROM w""",
    "capture_dates": r"""WITH p AS (SELECT DISTINCT commons_assertion_id, coalesce(date_iso, '') d, coalesce(place, '') p FROM commons_crop_circle_assertions), k AS (SELECT *, length(p) % 4 k FROM p),
c AS (SELECT *, CASE WHEN k = 0 AND regexp_matches(d, '^(19|20)\d\d') THEN 'about' WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'title' WHEN k = 2 AND regexp_matches(d, '^\d{4}-\d{2}-\d{2}$') THEN 'meta' WHEN k = 2 AND regexp_matches(d, '^(19|20)\d\d') THEN 'meta year' ELSE 'file' END w FROM k)
SELECT DISTINCT commons_assertion_id, d AS had, length(p) AS length, CASE w WHEN 'about' THEN d[1:4] WHEN 'title' THEN '2001-02-03' WHEN 'meta' THEN d WHEN 'meta year' THEN d[1:4] WHEN 'file' THEN '1999-08-07' ELSE '' END AS date, CASE w WHEN 'about' THEN 'year' WHEN 'meta year' THEN 'year' WHEN 'none' THEN 'unknown' ELSE 'day' END AS precision,
 CASE w WHEN 'about' THEN 'title_about' WHEN 'meta' THEN 'metadata' WHEN 'meta year' THEN 'metadata' WHEN 'none' THEN '' ELSE 'title' END AS origin FROM c""",
    "dated_places": "SELECT DISTINCT formation_id, year, CASE WHEN length(place) % 3 < 2 THEN month END AS month, CASE WHEN length(place) % 3 = 0 THEN day END AS day, CASE WHEN length(place) % 3 = 1 THEN 'early' ELSE '' END AS qualifier, trim(place) AS place FROM formations WHERE place <> ''",
    "snippets": r"""WITH d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, '[^\n]{0,30}\b(?:axis|bearing|azimuth|north|compass)\b[^\n]{0,30}'), lambda s: trim(s, ' ')) a, list_transform(regexp_extract_all(text, '[^\n]{0,30}\b(?:latitude|longitude|coordinates|grid reference)\b[^\n]{0,30}'), lambda s: trim(s, ' ')) b FROM documents WHERE text <> ''),
u AS (SELECT doc_id, list_filter(a, lambda s, i: list_position(a, s) = i)[1:8] a, list_filter(b, lambda s, i: list_position(b, s) = i)[1:8] b FROM d WHERE len(a) > 0 OR len(b) > 0)
SELECT DISTINCT doc_id, coalesce(array_to_string(a, ' || '), '') AS orientation, coalesce(array_to_string(b, ' || '), '') AS coordinate, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 'high' WHEN len(a) > 0 THEN 'medium' ELSE 'coordinate_only' END AS priority FROM u""",
    "forbidden_paths": """WITH e AS (SELECT event_id, '{"a": [{"Ground_Truth": 1}, {"b": {"k": ' || event_id % 7 || ', "' || CASE event_id % 3 WHEN 0 THEN 'final_coordinate' WHEN 1 THEN 'other' ELSE 'EVALUATOR_ONLY' END || '": [1, {"ok": 2}]}}], "c": ' || props || '}' AS j FROM events)
SELECT event_id, t.fullkey AS path FROM e, json_tree(e.j) t WHERE lower(t.key) IN ('ground_truth', 'final_coordinate', 'final_coordinates', 'evaluator_only')""",
    "url_forms": r"""WITH u AS (SELECT DISTINCT url FROM iccra_report_links_full WHERE url IS NOT NULL) SELECT url, 'https://' || regexp_replace(url, '^https?://', '') || '?a=1&b=2' AS one_form, url_decode(regexp_extract(url, '^https?://[^/]+(.*)$', 1) || '%20x') AS path,
 regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS stem, nullif(try_cast(regexp_extract(url, '(\d+)', 1) AS bigint), 0) AS first_number FROM u""",
    "page_roles": r"""SELECT CASE WHEN regexp_matches(url, '/annex/') THEN 'annex' WHEN regexp_matches(url, '/historical/') THEN 'historical' WHEN regexp_matches(url, '/byyear/\d{4}/') THEN 'year_page' WHEN regexp_matches(url, '/reports/\d{4}/') THEN 'report' WHEN regexp_matches(url, 'index-\d+') THEN 'index' ELSE 'other' END AS role,
 CASE WHEN regexp_matches(url, '(?i)\.(jpe?g|png|gif|tiff?)$') THEN 'picture' WHEN regexp_matches(url, '(?i)\.(pdf|docx?)$') THEN 'document' WHEN regexp_matches(url, '(?i)\.html?$') THEN 'page' ELSE 'other' END AS kind, count(*) AS rows, count(DISTINCT url) AS urls FROM iccra_report_links_full WHERE url IS NOT NULL GROUP BY 1, 2""",
    "country_parts": f"""WITH r AS (SELECT DISTINCT formation_id, country_code, concat_ws(', ', place, region, country) told FROM formations), l AS (SELECT *, list_filter(list_transform(string_split(told, ','), lambda v: trim(v)), lambda v: v <> '')[-1] p FROM r), n AS (SELECT *, coalesce({_N("p")}, '') q FROM l)
SELECT country_code, CASE {" ".join(f"WHEN q = '{n}' OR ends_with(q, ' {n}') THEN '{COUNTRIES[n]}'" for n in sorted(COUNTRIES, key=lambda n: (-len(n), n)))} END AS found, count(*) AS n FROM n GROUP BY 1, 2""",
    "same_event_names": f"""WITH r AS (SELECT DISTINCT formation_id, date_iso, country_code, coalesce({_N("place")}, '') p FROM formations), s AS (SELECT DISTINCT assertion_id, date_iso, country_code, coalesce({_N("place")}, '') p FROM source_assertions) SELECT DISTINCT formation_id AS a_id, assertion_id AS b_id FROM r a JOIN s b USING (date_iso, country_code) WHERE a.p <> '' AND b.p <> '' AND (a.p = b.p OR starts_with(a.p, b.p || ' ') OR starts_with(b.p, a.p || ' '))""",
    "page_pictures": f"SELECT url, 'pic1.jpg' AS image, greatest(k * 100 * 300, CASE WHEN k > 2 THEN 810000 ELSE 0 END)::int AS area FROM {_PAGE} UNION ALL SELECT url, 'pic2.jpg', 100 FROM {_PAGE}",
    "link_pictures": f"SELECT url, unnest(['one.htm', 'two.htm', 'three.htm']) AS link, unnest(['First & best', 'Second', 'Third']) AS text, unnest(['pic1.jpg', 'pic2.jpg', 'pic2.jpg']) AS image FROM {_PAGE}",
    "gazetteer_names": f"""WITH r AS (SELECT formation_id, min({{'place': place, 'country_code': country_code, 'region': region}}) f FROM formations GROUP BY 1), p AS (SELECT formation_id, f.country_code, list_prepend(f.place, string_split(replace(concat_ws(',', f.region, replace(f.place, ' ', ',')), ';', ','), ',')) n FROM r WHERE f.place <> ''),
n AS (SELECT formation_id, country_code, unnest(list_distinct(list_filter(list_transform(n, lambda v: {_N("v")}), lambda v: v <> ''))) AS name FROM p) SELECT country_code, name, min(formation_id) AS first_id, count(*) AS places FROM n GROUP BY 1, 2""",
    "footprint_search": """WITH s AS (SELECT o_orderkey, o_orderpriority AS collection, (o_orderkey % 20 - 10)::double w, (o_orderkey % 13 + 40)::double s, o_orderdate::date f, o_orderdate::date + (o_orderkey % 9)::int l FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY l DESC, o_orderkey) n FROM s WHERE w <= 2.5 AND w + 1.5 >= -1 AND s <= 46 AND s + 1 >= 44.5 AND f <= DATE '1996-12-31' AND l >= DATE '1995-01-01') SELECT collection, o_orderkey, strftime(l, '%Y-%m-%d') AS last, n FROM h WHERE n <= 10""",
}
