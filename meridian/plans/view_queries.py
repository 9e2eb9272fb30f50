"""Queries of map views, of scans with a vocabulary, and of counts whose order of arrival matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.text import normal
from meridian.operators import records, resolve, views
from meridian.runtime import table

_GOOD = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)"


def view_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of placed formations on a screen of 1,440 by 900 pixels about London, at zoom 6, with what they hold."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").where("matched_formation_id <> ''").groupBy(F.col("matched_formation_id").alias("formation_id")).agg(F.count_distinct("commons_image_id").alias("images"))
    rows = table(spark, sf_dir, "formations").where(_GOOD).select("formation_id", "latitude", "longitude", "geocode_method").distinct().join(pictures, "formation_id", "left")
    scale = 256 * 2**6 / 360
    points = rows.select(F.col("formation_id").alias("id"), ((F.col("longitude") + 0.1) * scale + 720).alias("x"), ((F.lit(51.5) - F.col("latitude")) * scale * 1.6 + 450).alias("y"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.coalesce("images", F.lit(0)).alias("images"), F.col("geocode_method").alias("role"), F.lit(False).alias("selected"))
    return views.view_clusters(points, 6, 1440, 900)


def cluster_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How markers made from orders are drawn and what a click on them does, at every zoom."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 61).alias("reports"), (k % 19).cast("double").alias("wide"), (k % 14).alias("zoom"))
    kind, size = views.drawn_as(F.col("reports"), F.col("zoom"))
    radius = F.coalesce(*(F.when(F.col("zoom") <= top, F.lit(r)) for top, r, _ in views.STEPS[:-1]), F.lit(views.STEPS[-1][1]))
    return rows.select("o_orderkey", kind.alias("kind"), size.alias("size"), views.on_click(F.col("reports"), F.col("wide"), F.col("zoom")).alias("action"), radius.alias("radius"))


def label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by pair, the last one of each counting, those of no known status left out."""
    clean = lambda c: F.lower(F.trim(c)).alias(c)
    rows = table(spark, sf_dir, "formation_alias_reviews").select(clean("alias_formation_id"), clean("canonical_formation_id"), clean("review_status"), "reviewed_at", F.coalesce("reason", F.lit("")).alias("reason"))
    rows = rows.where(F.col("review_status").isin("accepted", "rejected", "pending", "deferred") & F.col("alias_formation_id").isNotNull() & F.col("canonical_formation_id").isNotNull())
    last = rows.groupBy("alias_formation_id", "canonical_formation_id").agg(F.max(F.struct(F.coalesce("reviewed_at", F.lit("0001-01-01").cast("date")).alias("at"), "review_status", "reason")).alias("r"))
    return last.select("alias_formation_id", "canonical_formation_id", F.col("r.review_status").alias("review_status"))


def event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture's records: how many, whether all have one date and one country, and all know their formation."""
    known = table(spark, sf_dir, "formations").select(F.col("formation_id").alias("matched_formation_id")).distinct().withColumn("there", F.lit(True))
    rows = table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_image_id", "commons_assertion_id", "date_iso", "country_code", F.nullif("matched_formation_id", F.lit("")).alias("matched_formation_id")).distinct().join(known, "matched_formation_id", "left")
    one = lambda c: (F.count_distinct(F.coalesce(c, F.lit(""))) == 1)
    return rows.groupBy("commons_image_id").agg(F.count_distinct("commons_assertion_id").alias("records"), one("date_iso").alias("one_date"), one("country_code").alias("one_country"), F.bool_and(F.col("matched_formation_id").isNull() | F.col("there").isNotNull()).alias("known"))


def flat_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks' nested parts flattened: the addresses in their JSON list, and the camera as one JSON object without what it lacks."""
    rows = table(spark, sf_dir, "legacy_kml_candidate_queue").select("legacy_candidate_id", "original_url_strings_json", "look_at_heading", "look_at_range").distinct()
    urls = F.from_json("original_url_strings_json", "array<string>")
    there = lambda c: F.when(~F.isnan(c), F.col(c).cast("int"))
    camera = F.to_json(F.struct(there("look_at_heading").alias("heading"), there("look_at_range").alias("range")))
    return rows.select("legacy_candidate_id", F.coalesce(F.size(urls), F.lit(0)).alias("urls"), F.get(urls, F.lit(0)).alias("first_url"), camera.alias("camera"))


def source_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's relation parted by source: those of one page and slot, those of a record, and the rest; each row in one part only."""
    rows = table(spark, sf_dir, "source_assertions").select("assertion_id", "source_name", "source_page", "source_slot", "source_record_url").distinct()
    part = F.when(F.col("source_page").isNotNull() & F.col("source_slot").isNotNull(), "slots").when(F.col("source_record_url") != "", "records").otherwise("rest")
    parts = rows.withColumn("part", part)
    return parts.groupBy("part", "source_name").agg(F.count("*").alias("n"), F.count_distinct("source_page", "source_slot").alias("slots"), F.min("assertion_id").alias("first_id"))


def formation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formations with most pictures, and for them alone the assertions of their date and place."""
    top = table(spark, sf_dir, "commons_crop_circle_assertions").where("matched_formation_id <> ''").groupBy(F.col("matched_formation_id").alias("formation_id")).agg(F.count_distinct("commons_image_id").alias("pictures")).orderBy(F.desc("pictures"), "formation_id").limit(20)
    known = resolve.keep_first(table(spark, sf_dir, "formations").select("formation_id", "date_iso", normal(F.col("place")).alias("p")).distinct(), ["formation_id"], F.col("date_iso"), F.col("p")).join(top, "formation_id")
    told = table(spark, sf_dir, "source_assertions").select("assertion_id", "date_iso", normal(F.col("place")).alias("p")).where("p <> ''").distinct()
    return known.join(told, ["date_iso", "p"], "left").groupBy("formation_id", "pictures").agg(F.count("assertion_id").alias("told"), F.min("assertion_id").alias("first_id"))


def countries_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen countries with most assertions; of equally frequent ones those that came first."""
    rows = table(spark, sf_dir, "source_assertions").where("country_code <> ''").groupBy("country_code").agg(F.count_distinct("assertion_id").alias("n"), F.min(F.struct("batch_no", "retrieved_at", "assertion_id")).alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(15).select("country_code", "n")


def merged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of one content as one: all roles in order, the longest text, the largest size, the first address."""
    links = table(spark, sf_dir, "iccra_report_links_full").where("sha256 <> ''")
    roles = links.select("sha256", F.explode(F.split(F.coalesce("roles", F.lit("")), ";")).alias("role")).where("role <> ''").groupBy("sha256").agg(resolve.joined_set(F.col("role")).alias("roles"))
    text = F.coalesce("anchor_text", F.lit(""))
    best = links.groupBy("sha256").agg(F.min(F.struct((-F.length(text)).alias("less"), text.alias("text"))).alias("t"), F.max("bytes").alias("bytes"), F.min("url").alias("url"), F.count("*").alias("rows"))
    return best.join(roles, "sha256", "left").select("sha256", F.coalesce("roles", F.lit("")).alias("roles"), F.col("t.text").alias("text"), "bytes", "url", "rows")


def stated_and_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year: formations known, assertions parsed and pictures taken, with how far each falls short of the known; years of any of the three."""
    year = lambda c: F.substring(c, 1, 4)
    known = table(spark, sf_dir, "formations").groupBy(year("date_iso").alias("year")).agg(F.count_distinct("formation_id").alias("known"))
    parsed = table(spark, sf_dir, "source_assertions").groupBy(year("date_iso").alias("year")).agg(F.count_distinct("assertion_id").alias("parsed"))
    taken = table(spark, sf_dir, "commons_crop_circle_assertions").groupBy(year("date_iso").alias("year")).agg(F.count_distinct("commons_image_id").alias("captured"))
    every = known.join(parsed, "year", "full").join(taken, "year", "full").where("year <> ''")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.select("year", *(zero(c).alias(c) for c in ("known", "parsed", "captured")), (zero("parsed") - zero("known")).alias("parsed_delta"), (zero("captured") - zero("known")).alias("captured_delta"))


def joined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources as one table in order, with the ids that more than one of them, or a source twice, has."""
    parts = [("history", "batch_no = 0"), ("expansion", "batch_no BETWEEN 1 AND 4"), ("late", "batch_no > 4")]
    rows = table(spark, sf_dir, "source_assertions").select("assertion_id", "batch_no").distinct()
    every = records.union_types([(name, rows.where(when), {"id": F.col("assertion_id")}) for name, when in parts])
    per = every.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("source_kind").alias("kinds"))
    return every.join(per, "id").groupBy("source_kind").agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("kinds") > 1).alias("in_several"))


def threshold_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of segments by the strength of the longest, the dominant and the share of the dominant, with the weighted score; made from lines."""
    k = F.col("l_partkey") * 7 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (k % 50 / 100).alias("a"), (k % 97 / 97).alias("b"), (k % 41 / 82).alias("c"))
    high = "a >= 0.38 OR (a >= 0.26 AND c >= 0.20) OR (b >= 0.90 AND c >= 0.15) OR (c >= 0.35 AND b >= 0.35 AND a >= 0.12)"
    medium = "(a >= 0.16 AND c >= 0.20) OR (b >= 0.75 AND c >= 0.18) OR (c >= 0.32 AND b >= 0.28)"
    low = "a >= 0.15 OR b >= 0.40 OR (c >= 0.28 AND b >= 0.22)"
    score = F.least(F.col("a") / 0.38, F.lit(1.0)) * 0.45 + F.least(F.col("b") / 0.90, F.lit(1.0)) * 0.35 + F.least(F.col("c") / 0.35, F.lit(1.0)) * 0.20
    tier = F.when(F.expr(high), "high").when(F.expr(medium), "medium").when(F.expr(low), "low").otherwise("none")
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.max(score), 6).alias("best_score"))


def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks by the first rule of an ordered table that their words or position meet, with its rank and label."""
    words = F.lower(F.concat_ws(" ", F.coalesce("placemark_name", F.lit("")), F.coalesce("folder", F.lit("")), F.coalesce("description_inert_text", F.lit(""))))
    rules = [(1, "field", words.contains("field")), (2, "site", words.rlike("site|down|hill")), (3, "southern england", F.col("latitude").between(50.5, 52.0) & F.col("longitude").between(-3.0, 0.5)), (4, "uncertain", words.contains("?")), (5, "named", F.coalesce("placemark_name", F.lit("")) != "")]
    rank = F.coalesce(*(F.when(c, F.lit(r)) for r, _, c in rules), F.lit(9))
    label = F.coalesce(*(F.when(c, F.lit(n)) for _, n, c in rules), F.lit("other"))
    return table(spark, sf_dir, "legacy_kml_candidate_queue").groupBy(rank.alias("rank"), label.alias("label")).agg(F.count("*").alias("n"), F.count_distinct("legacy_candidate_id").alias("ids"))


QUERIES = {f.__name__: f for f in (
    view_clusters, cluster_actions, label_scan, event_images, flat_marks, source_partitions, formation_context, countries_first_seen, merged_references, stated_and_captured, joined_sources, threshold_tiers, context_rules,
)}

_N = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
_HIGH = "a >= 0.38 OR (a >= 0.26 AND c >= 0.20) OR (b >= 0.90 AND c >= 0.15) OR (c >= 0.35 AND b >= 0.35 AND a >= 0.12)"
_MED = "(a >= 0.16 AND c >= 0.20) OR (b >= 0.75 AND c >= 0.18) OR (c >= 0.32 AND b >= 0.28)"
_LOW = "a >= 0.15 OR b >= 0.40 OR (c >= 0.28 AND b >= 0.22)"
_W = "lower(concat_ws(' ', coalesce(placemark_name, ''), coalesce(folder, ''), coalesce(description_inert_text, '')))"
SQL = {
    "cluster_actions": """WITH k AS (SELECT o_orderkey, o_orderkey % 61 r, o_orderkey % 19 w, o_orderkey % 14 z FROM orders) SELECT o_orderkey, CASE WHEN z <= 7 OR r > 1 THEN 'cluster' ELSE 'individual' END AS kind, CASE WHEN r >= 50 THEN 'large' WHEN r >= 10 THEN 'medium' ELSE 'small' END AS size,
 CASE WHEN r <= 1 THEN CASE WHEN z < 8 THEN 'zoom' ELSE 'open_archive' END WHEN w > 8 AND z < 11 THEN 'zoom' ELSE 'choose' END AS action, CASE WHEN z <= 2 THEN 32 WHEN z <= 4 THEN 70 WHEN z <= 7 THEN 90 WHEN z <= 10 THEN 64 ELSE 18 END AS radius FROM k""",
    "label_scan": """WITH r AS (SELECT lower(trim(alias_formation_id)) a, lower(trim(canonical_formation_id)) c, lower(trim(review_status)) s, coalesce(reviewed_at, DATE '0001-01-01') d, coalesce(reason, '') w FROM formation_alias_reviews WHERE alias_formation_id IS NOT NULL AND canonical_formation_id IS NOT NULL)
SELECT a AS alias_formation_id, c AS canonical_formation_id, s AS review_status FROM (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY d DESC, s DESC, w DESC) n FROM r WHERE s IN ('accepted', 'rejected', 'pending', 'deferred')) WHERE n = 1""",
    "event_images": "SELECT commons_image_id, count(DISTINCT commons_assertion_id) AS records, count(DISTINCT coalesce(date_iso, '')) = 1 AS one_date, count(DISTINCT coalesce(country_code, '')) = 1 AS one_country, bool_and(coalesce(matched_formation_id, '') = '' OR matched_formation_id IN (SELECT formation_id FROM formations)) AS known FROM commons_crop_circle_assertions GROUP BY 1",
    "flat_marks": """WITH r AS (SELECT DISTINCT legacy_candidate_id, original_url_strings_json j, look_at_heading h, look_at_range g FROM legacy_kml_candidate_queue), c AS (SELECT *, CASE WHEN NOT isnan(h) THEN trunc(h)::int END hi, CASE WHEN NOT isnan(g) THEN trunc(g)::int END gi FROM r)
SELECT legacy_candidate_id, coalesce(json_array_length(try_cast(j AS json)), 0)::int AS urls, try_cast(j AS json) ->> '$[0]' AS first_url, '{' || concat_ws(',', CASE WHEN hi IS NOT NULL THEN '"heading":' || hi END, CASE WHEN gi IS NOT NULL THEN '"range":' || gi END) || '}' AS camera FROM c""",
    "source_partitions": """WITH r AS (SELECT DISTINCT assertion_id, source_name, source_page, source_slot, source_record_url FROM source_assertions), p AS (SELECT *, CASE WHEN source_page IS NOT NULL AND source_slot IS NOT NULL THEN 'slots' WHEN source_record_url <> '' THEN 'records' ELSE 'rest' END part FROM r)
SELECT part, source_name, count(*) AS n, count(DISTINCT CASE WHEN source_page IS NOT NULL AND source_slot IS NOT NULL THEN source_page || '|' || source_slot END) AS slots, min(assertion_id) AS first_id FROM p GROUP BY 1, 2""",
    "formation_context": f"""WITH t AS (SELECT matched_formation_id f, count(DISTINCT commons_image_id) pictures FROM commons_crop_circle_assertions WHERE matched_formation_id <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), k AS (SELECT * FROM (SELECT formation_id, date_iso, {_N("place")} p, row_number() OVER (PARTITION BY formation_id ORDER BY date_iso, {_N("place")}) n FROM formations) WHERE n = 1),
a AS (SELECT DISTINCT assertion_id, date_iso, {_N("place")} p FROM source_assertions) SELECT formation_id, pictures, count(assertion_id) AS told, min(assertion_id) AS first_id FROM t JOIN k ON f = formation_id LEFT JOIN a ON a.date_iso = k.date_iso AND a.p = k.p AND a.p <> '' GROUP BY 1, 2""",
    "countries_first_seen": "WITH r AS (SELECT country_code, count(DISTINCT assertion_id) n, min({'b': batch_no, 'r': retrieved_at, 'a': assertion_id}) f FROM source_assertions WHERE country_code <> '' GROUP BY 1) SELECT country_code, n FROM r ORDER BY n DESC, f LIMIT 15",
    "merged_references": """WITH l AS (SELECT * FROM iccra_report_links_full WHERE sha256 <> ''), e AS (SELECT sha256, unnest(string_split(coalesce(roles, ''), ';')) r FROM l), g AS (SELECT sha256, string_agg(DISTINCT r, '; ' ORDER BY r) s FROM e WHERE r <> '' GROUP BY 1),
b AS (SELECT sha256, max(bytes) bytes, min(url) url, count(*) n FROM l GROUP BY 1), t AS (SELECT sha256, coalesce(anchor_text, '') x, row_number() OVER (PARTITION BY sha256 ORDER BY length(coalesce(anchor_text, '')) DESC, coalesce(anchor_text, '')) k FROM l) SELECT b.sha256, coalesce(s, '') AS roles, x AS text, bytes, url, n AS rows FROM b JOIN t ON t.sha256 = b.sha256 AND k = 1 LEFT JOIN g ON g.sha256 = b.sha256""",
    "stated_and_captured": """WITH k AS (SELECT date_iso[1:4] y, count(DISTINCT formation_id) n FROM formations GROUP BY 1), p AS (SELECT date_iso[1:4] y, count(DISTINCT assertion_id) n FROM source_assertions GROUP BY 1), c AS (SELECT date_iso[1:4] y, count(DISTINCT commons_image_id) n FROM commons_crop_circle_assertions GROUP BY 1),
a AS (SELECT coalesce(k.y, p.y, c.y) AS year, coalesce(k.n, 0) known, coalesce(p.n, 0) parsed, coalesce(c.n, 0) captured FROM k FULL JOIN p ON p.y = k.y FULL JOIN c ON c.y = coalesce(k.y, p.y)) SELECT year, known, parsed, captured, parsed - known AS parsed_delta, captured - known AS captured_delta FROM a WHERE year <> ''""",
    "joined_sources": """WITH r AS (SELECT DISTINCT assertion_id id, CASE WHEN batch_no = 0 THEN 'history' WHEN batch_no BETWEEN 1 AND 4 THEN 'expansion' WHEN batch_no > 4 THEN 'late' END k, batch_no FROM source_assertions), e AS (SELECT * FROM r WHERE k IS NOT NULL), p AS (SELECT id, count(*) n, count(DISTINCT k) m FROM e GROUP BY 1)
SELECT k AS source_kind, count(*) AS rows, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE m > 1) AS in_several FROM e JOIN p USING (id) GROUP BY 1""",
    "threshold_tiers": f"""WITH k AS (SELECT l_partkey * 7 + l_linenumber k FROM lineitem), v AS (SELECT k % 50 / 100.0::double a, k % 97 / 97.0::double b, k % 41 / 82.0::double c FROM k), s AS (SELECT CASE WHEN {_HIGH} THEN 'high' WHEN {_MED} THEN 'medium' WHEN {_LOW} THEN 'low' ELSE 'none' END AS tier, 0.45 * least(a / 0.38, 1) + 0.35 * least(b / 0.90, 1) + 0.20 * least(c / 0.35, 1) sc FROM v)
SELECT tier, count(*) AS n, round(avg(sc), 6) AS mean_score, round(max(sc), 6) AS best_score FROM s GROUP BY 1""",
    "context_rules": f"""WITH r AS (SELECT legacy_candidate_id, CASE WHEN contains({_W}, 'field') THEN 1 WHEN regexp_matches({_W}, 'site|down|hill') THEN 2 WHEN latitude BETWEEN 50.5 AND 52.0 AND longitude BETWEEN -3.0 AND 0.5 THEN 3 WHEN contains({_W}, '?') THEN 4 WHEN coalesce(placemark_name, '') <> '' THEN 5 ELSE 9 END AS rank FROM legacy_kml_candidate_queue)
SELECT rank, CASE rank WHEN 1 THEN 'field' WHEN 2 THEN 'site' WHEN 3 THEN 'southern england' WHEN 4 THEN 'uncertain' WHEN 5 THEN 'named' ELSE 'other' END AS label, count(*) AS n, count(DISTINCT legacy_candidate_id) AS ids FROM r GROUP BY 1, 2""",
}
