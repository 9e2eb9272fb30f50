"""Queries of the text, link, date, identifier and nested operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import dates, text
from meridian.operators import resolve
from meridian.runtime import table
from meridian.sources.files import geojson
from meridian.streaming.events import once, sessions


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short hashed ids of documents by two hashes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return rows.select("doc_id", text.stable_id("a_", F.col("source"), F.col("lang"), F.col("doc_id")).alias("a_id"), text.stable_id("img_", F.col("source"), F.col("doc_id"), bits=256, length=20).alias("img_id"))


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of assertions' places."""
    return table(spark, sf_dir, "source_assertions").select("assertion_id", text.normal(F.col("place")).alias("name")).distinct()


def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded forms of formations' places, marks dropped."""
    return table(spark, sf_dir, "formations").select("formation_id", text.folded(F.col("place")).alias("name")).distinct()


def place_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each picture's place is to its recorded formation's."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_assertion_id", F.col("place").alias("told"), F.col("matched_formation_id").alias("formation_id")).distinct()
    known = resolve.keep_first(table(spark, sf_dir, "formations"), ["formation_id"], F.col("date_iso")).select("formation_id", "place")
    return pictures.join(known, "formation_id").select("commons_assertion_id", "formation_id", F.round(text.place_similarity(F.col("told"), F.col("place")), 6).alias("similarity"))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of each assertion's listing with its place and region."""
    rows = table(spark, sf_dir, "source_assertions").select("assertion_id", "source_listing_text", "place", "region").distinct()
    a, b = text.tokens(F.col("source_listing_text"), 3), text.tokens(F.concat_ws(" ", "place", "region"), 3)
    return rows.select("assertion_id", F.round(text.overlap(a, b), 6).alias("overlap"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses of links whose host is written large."""
    rows = table(spark, sf_dir, "iccra_report_links_full").select("url").distinct()
    odd = F.concat(F.upper(F.regexp_extract("url", "^(https?://[^/]+)", 1)), F.regexp_replace("url", "^https?://[^/]+", ""), F.lit("#part"))
    return rows.select("url", text.canonical_url(odd).alias("canonical"), text.url_key(F.col("url")).alias("key"), text.directory(F.col("url")).alias("directory"))


def url_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page key: its addresses, pages that link to it, and fetches."""
    rows = table(spark, sf_dir, "iccra_report_links_full").select(text.url_key(F.col("url")).alias("key"), "url", "discovered_from", "sha256")
    return rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"), resolve.joined_set(F.col("discovered_from")).alias("pages"), F.count_distinct("sha256").alias("contents"))


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with addresses, how many, and the first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.links(F.col("text")).alias("links"))
    return rows.where(F.size("links") > 0).select("doc_id", F.size("links").alias("n"), F.element_at("links", 1).alias("first_link"))


def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence of direction documents hold, and its priority."""
    has = lambda *w: F.coalesce(F.lower("text").rlike("|".join(w)), F.lit(False))
    rows = table(spark, sf_dir, "documents").select("doc_id", has("azimuth", "bearing", "true north").alias("direction"), has("axis", "tramline").alias("line"), has(r"-?\d{1,3}\.\d{4,}").alias("coordinate"))
    rank = F.when(F.col("direction") & F.col("coordinate"), "high").when(F.col("direction"), "medium").when(F.col("line"), "low").when(F.col("coordinate"), "coordinate_only").otherwise("none")
    return rows.select("doc_id", rank.alias("priority")).groupBy("priority").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source with what looks like keys, addresses of mail, or long runs."""
    rows = table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("t"))
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("t").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("mail"), F.count_if(F.col("t").rlike(r"(AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----)")).alias("keys"), F.count_if(F.col("t").rlike(r"[A-Za-z0-9+/=_-]{80,}")).alias("runs"))


def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals and precision of pictures' partial dates."""
    rows = table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_assertion_id", "date_iso").distinct()
    low, high = dates.interval(F.col("date_iso"))
    return rows.select("commons_assertion_id", F.date_format(low, "yyyy-MM-dd").alias("low"), F.date_format(high, "yyyy-MM-dd").alias("high"), dates.precision(F.col("date_iso")).alias("precision"))


def temporal_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pictures' dates lie to their recorded formations' dates."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_assertion_id", F.col("date_iso").alias("d"), F.col("matched_formation_id").alias("formation_id")).distinct()
    known = table(spark, sf_dir, "formations").select("formation_id", "date_iso").distinct()
    return pictures.join(known, "formation_id").groupBy(dates.relation(F.col("date_iso"), F.col("d")).alias("relation")).agg(F.count("*").alias("n"))


def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read from labels made of formations' dates."""
    rows = table(spark, sf_dir, "formations").select("formation_id", "date_iso").distinct()
    day = F.try_to_date("date_iso", "yyyy-MM-dd")
    label = F.concat(F.lit("early "), F.date_format(day, "d"), F.lit(" "), F.date_format(day, "MMMM"), F.lit(" "), F.date_format(day, "yyyy"), F.lit(", seen from the road"))
    return rows.select("formation_id", dates.labelled(label).alias("told"), dates.year_of(F.col("date_iso")).alias("year"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in events' properties, by type."""
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that events' properties use, with those that are not allowed."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", (~F.col("key").isin("ref", "page")).alias("forbidden"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations as GeoJSON points: what their features say of position and place."""
    rows = table(spark, sf_dir, "formations").select("formation_id", "latitude", "longitude", "place", "region").distinct()
    said = geojson(rows, "formation_id", "latitude", "longitude", ["place", "region"])
    value = lambda p: F.get_json_object("feature", p)
    return said.select("formation_id", value("$.geometry.coordinates[0]").cast("double").alias("longitude"), value("$.geometry.coordinates[1]").cast("double").alias("latitude"), value("$.properties.place").alias("place"), value("$.properties.region").alias("region"))


def nested_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original addresses of placemarks from their JSON arrays: counts and hosts."""
    rows = table(spark, sf_dir, "legacy_kml_candidate_queue").select("legacy_candidate_id", "original_url_strings_json").distinct()
    urls = F.coalesce(F.from_json("original_url_strings_json", "array<string>"), F.array().cast("array<string>"))
    return rows.groupBy(F.size(urls).alias("urls")).agg(F.count("*").alias("candidates"))


def filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations of the nineties in Germany or Britain with ``wald`` in any of five columns."""
    rows = table(spark, sf_dir, "formations").distinct()
    told = F.lower(F.concat_ws(" ", "formation_id", "place", "region", "county", "crop"))
    return rows.where(told.contains("wald") & F.col("year").between(1990, 1999) & F.col("country_code").isin("DE", "GB")).select("formation_id", "place", "year", "country_code")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events with gaps of at most half an hour; the same code runs on a stream."""
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def event_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events without repeats of user, type and second."""
    rows = table(spark, sf_dir, "events").withColumn("second", F.date_trunc("second", "ts"))
    return once(rows, ["user_id", "event_type", "second"], "ts").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    stable_ids, text_normalise, text_fold, place_similarity, token_overlap, url_canonical, url_registry, document_links, evidence_snippets, secret_scan, partial_dates, temporal_relation, date_labels, json_extract, forbidden_keys,
    geojson_features, nested_queue, filter_search, event_sessions, event_once,
)}

_W = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))".format
SQL = {
    "stable_ids": "SELECT doc_id, 'a_' || substr(sha1(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || doc_id), 1, 14) AS a_id, 'img_' || substr(sha256(coalesce(source, '') || '|' || doc_id), 1, 20) AS img_id FROM documents",
    "text_normalise": "SELECT DISTINCT assertion_id, trim(regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')) AS name FROM source_assertions",
    "token_overlap": f"WITH r AS (SELECT DISTINCT assertion_id, source_listing_text t, place, region FROM source_assertions), w AS (SELECT assertion_id, {_W("coalesce(t, '')")} a, {_W("concat_ws(' ', place, region)")} b FROM r) SELECT assertion_id, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0)::double, 0), 6) AS overlap FROM w",
    "url_canonical": "SELECT DISTINCT url, url AS canonical, lower(regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '') || regexp_replace(url_decode(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\\s+', ' ', 'g') || CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' THEN '?' || trim(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) ELSE '' END) AS key, regexp_replace(url, '/[^/]*$', '/') AS directory FROM iccra_report_links_full",
    "url_registry": """SELECT lower(regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '') || regexp_replace(url_decode(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\\s+', ' ', 'g') || CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' THEN '?' || trim(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) ELSE '' END) AS key, count(*) AS rows, count(DISTINCT url) AS urls, coalesce(string_agg(DISTINCT discovered_from, '; ' ORDER BY discovered_from) FILTER (WHERE discovered_from <> ''), '') AS pages, count(DISTINCT sha256) AS contents FROM iccra_report_links_full GROUP BY 1""",
    "document_links": """WITH l AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s<>"'']+'), lambda x: regexp_replace(x, '[.,;:!?)\\]]+$', '')) AS l FROM documents)
SELECT doc_id, len(list_distinct(l))::int AS n, l[1] AS first_link FROM l WHERE len(l) > 0""",
    "evidence_snippets": """WITH f AS (SELECT doc_id, coalesce(regexp_matches(lower(text), 'azimuth|bearing|true north'), false) d, coalesce(regexp_matches(lower(text), 'axis|tramline'), false) l, coalesce(regexp_matches(lower(text), '-?\\d{1,3}\\.\\d{4,}'), false) c FROM documents)
SELECT CASE WHEN d AND c THEN 'high' WHEN d THEN 'medium' WHEN l THEN 'low' WHEN c THEN 'coordinate_only' ELSE 'none' END AS priority, count(*) AS documents, min(doc_id) AS first_doc FROM f GROUP BY 1""",
    "secret_scan": """SELECT source, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS mail, count(*) FILTER (WHERE regexp_matches(text, '(AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----)')) AS keys, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9+/=_-]{80,}')) AS runs FROM documents GROUP BY 1""",
    "partial_dates": """WITH r AS (SELECT DISTINCT commons_assertion_id, date_iso d FROM commons_crop_circle_assertions), l AS (SELECT *, CASE WHEN regexp_matches(d, '^\\d{4}(-\\d{2}(-\\d{2})?)?$') THEN try_cast(d || CASE length(d) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS date) END AS lo FROM r)
SELECT commons_assertion_id, strftime(lo, '%Y-%m-%d') AS low, strftime(CASE length(d) WHEN 4 THEN try_cast(d || '-12-31' AS date) WHEN 7 THEN last_day(lo) ELSE lo END, '%Y-%m-%d') AS high, CASE WHEN regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'day' WHEN regexp_matches(d, '^\\d{4}-\\d{2}$') THEN 'month' WHEN regexp_matches(d, '^\\d{4}$') THEN 'year' ELSE 'unknown' END AS precision FROM l""",
    "text_fold": "SELECT DISTINCT formation_id, trim(regexp_replace(strip_accents(lower(place)), '[^a-z0-9]+', ' ', 'g')) AS name FROM formations",
    "temporal_relation": """WITH p AS (SELECT DISTINCT commons_assertion_id, date_iso d, matched_formation_id AS formation_id FROM commons_crop_circle_assertions), f AS (SELECT DISTINCT formation_id, date_iso fd FROM formations),
j AS (SELECT fd::date a, try_cast(d || CASE length(d) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS date) lo, d FROM p JOIN f USING (formation_id)), k AS (SELECT a, lo, CASE length(d) WHEN 4 THEN try_cast(d || '-12-31' AS date) WHEN 7 THEN last_day(lo) ELSE lo END hi FROM j)
SELECT CASE WHEN lo > a THEN 'later' WHEN hi < a THEN 'earlier' ELSE 'overlap_or_indeterminate' END AS relation, count(*) AS n FROM k GROUP BY 1""",
    "date_labels": "SELECT DISTINCT formation_id, date_iso AS told, substr(date_iso, 1, 4)::int AS year FROM formations",
    "json_extract": "SELECT event_type, count(k) AS n, sum(k) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS int) k FROM events) GROUP BY 1",
    "forbidden_keys": "SELECT key, count(*) AS n, key NOT IN ('ref', 'page') AS forbidden FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "geojson_features": "SELECT DISTINCT formation_id, round(longitude, 7) AS longitude, round(latitude, 7) AS latitude, nullif(place, '') AS place, nullif(region, '') AS region FROM formations WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)",
    "nested_queue": "SELECT coalesce(json_array_length(CASE WHEN json_valid(original_url_strings_json) THEN original_url_strings_json END), 0)::int AS urls, count(*) AS candidates FROM (SELECT DISTINCT legacy_candidate_id, original_url_strings_json FROM legacy_kml_candidate_queue) GROUP BY 1",
    "filter_search": "SELECT formation_id, place, year, country_code FROM (SELECT DISTINCT * FROM formations) WHERE lower(concat_ws(' ', formation_id, place, region, county, crop)) LIKE '%wald%' AND year BETWEEN 1990 AND 1999 AND country_code IN ('DE', 'GB')",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END s FROM events), r AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) r FROM g), c AS (SELECT user_id, r, count(*) n FROM r GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "event_once": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('second', ts) FROM events) GROUP BY 1",
}
