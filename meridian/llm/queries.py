"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.llm.bpe import decode, encode
from meridian.llm.components import components
from meridian.llm.confusables import unify
from meridian.llm.history import retold
from meridian.llm.linkage import link
from meridian.llm.mojibake import repair
from meridian.llm.packing import pack_documents
from meridian.llm.splitting import split_documents
from meridian.llm.survivors import chosen, survivors
from meridian.runtime import table, written

# Match statuses from the most trusted.
STATUS_LADDER = [
    "reviewed_same_event_later_documentation", "exact_place_and_date", "place_and_year_candidate", "coordinate_and_date_candidate",
    "ambiguous_place_and_year_candidate", "ambiguous_coordinate_and_date_candidate", "no_defensible_existing_formation_match",
]
SURVIVOR_FIELDS = ["date_iso", "place", "region", "country", "country_code", "latitude", "longitude", "match_distance_km", "overlay_readiness", "provenance_note"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of later batches with the row of the lowest batch that tells the same event."""
    pairs = retold(table(spark, sf_dir, "source_assertions"))
    return pairs.select(F.least("id", "earlier").alias("assertion_id_a"), F.greatest("id", "earlier").alias("assertion_id_b")).distinct()


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose anchor is garbled, with the anchor restored as far as can be."""
    return repair(table(spark, sf_dir, "iccra_report_links_full"), "url", "anchor_text").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_repairs(spark, sf_dir).select("url").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and anchors that hold look-alike or invisible characters, with their consistent form.

    Garbled anchors are no cases; what their decoding left is judged by the operator of problem 3, whose
    reading must describe the anchor in no more than its consistent form does.
    """
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").select(F.lit("commons_crop_circle_assertions").alias("table_name"), F.col("commons_assertion_id").alias("record_key"), F.col("place").alias("text"))
    links = table(spark, sf_dir, "iccra_report_links_full").select(F.lit("iccra_report_links_full").alias("table_name"), F.col("url").alias("record_key"), F.col("anchor_text").alias("text"))
    forms = written(unify(pictures.unionByName(links), ["table_name", "record_key"], "text"), "forms")
    # Only anchors that hold something of the kind are asked whether they are garbled.
    anchors = forms.where(F.col("table_name") == "iccra_report_links_full").select("table_name", F.col("text").alias("key"), "text", "unified").distinct()
    garbled = repair(anchors, "key", "text", corpus=links, rival="unified").select(F.lit("iccra_report_links_full").alias("table_name"), F.col("key").alias("text")).distinct()
    return forms.join(garbled, ["table_name", "text"], "left_anti").select("table_name", "record_key", "text", "unified")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_forms(spark, sf_dir).select("table_name", "record_key").distinct()


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture record's formation, with a confidence."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions")
    trusted = F.lower(F.trim("match_status")).isin(*STATUS_LADDER[:3])
    return link(table(spark, sf_dir, "formations"), pictures, "formation_id", "commons_assertion_id", "matched_formation_id", trusted)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_links(spark, sf_dir).select("formation_id", "commons_assertion_id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving picture record of each formation, its missing fields filled from the others."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions")
    return survivors(pictures, "matched_formation_id", "commons_assertion_id", "match_status", STATUS_LADDER, SURVIVOR_FIELDS, "retrieved_at", "commons_image_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors alone: what fills their fields has no part in their choice, so it is not computed."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions")
    return chosen(pictures, "matched_formation_id", "commons_assertion_id", "match_status", STATUS_LADDER, SURVIVOR_FIELDS, "retrieved_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every formation id in the accepted alias pairs."""
    reviews = table(spark, sf_dir, "formation_alias_reviews").where(F.lower(F.trim("review_status")) == "accepted")
    return components(reviews, "alias_formation_id", "canonical_formation_id").withColumnRenamed("id", "formation_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container of 2,048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 2048)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 512 tokens of every longer document."""
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 64)


def p8_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document has its ids, and they spell its text: texts, ids missing, texts that don't come back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode(docs, "doc_id", "text").select("doc_id", F.xxhash64(decode(F.col("ids"))).alias("back"), F.size("ids").alias("n"))
    # Repeated documents are compared as often as they are there.
    side = lambda df, c: df.groupBy("doc_id", c.alias("h")).agg(F.count("*").alias("n"))
    told, got = side(docs, F.xxhash64("text")), side(ids, F.col("back"))
    same = told.join(got.withColumnRenamed("n", "m"), ["doc_id", "h"], "full")
    return same.agg(F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("m", F.lit(0))), 1)), F.lit(0)).alias("different"))


def p9_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of containers: every document is in one, none is over-full, only what exceeds one is cut, and how full they are."""
    docs = table(spark, sf_dir, "documents")
    rows = written(pack_documents(docs, "doc_id", "text", 2048).select("doc_id", "piece", "size", "container_id", "container_size"), "audit")
    boxes = rows.groupBy("container_id").agg(F.sum("size").alias("s"), F.max("container_size").alias("told"))
    box = boxes.agg(F.count_if(F.col("s") > 2048).alias("over_full"), F.count_if(F.col("s") != F.col("told")).alias("miscounted"), (F.sum("s") >= 0.98 * 2048 * (F.count("*") - 5)).alias("well_filled"))
    texts = rows.groupBy("doc_id").agg(F.sum("size").alias("s"), F.max("piece").alias("p"))
    cut = texts.agg(F.count("*").alias("documents"), F.count_if((F.col("p") > 0) & (F.col("s") <= 2048)).alias("cut_in_vain"))
    return cut.crossJoin(box)  # one row each


def p10_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of pieces: texts in order from end to end, none over the limit, neighbours sharing, numbers without gaps."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("length")).distinct()
    pieces = split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 64).select("doc_id", "piece", "start", "end", "tokens", (F.length("text") == F.col("end") - F.col("start")).alias("whole")).distinct()
    at = Window.partitionBy("doc_id").orderBy("piece")
    rows = pieces.withColumns({"before": F.lag("end").over(at), "last": F.lag("start").over(at)})
    rows = rows.groupBy("doc_id").agg(
        F.max("tokens").alias("most"), F.bool_and("whole").alias("whole"), F.min("start").alias("first"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("piece").alias("top"),
        F.bool_and(F.coalesce((F.col("start") <= F.col("before")) & (F.col("start") > F.col("last")), F.lit(True))).alias("tiled"),
    )
    sound = (F.col("most") <= 512) & F.col("whole") & (F.col("first") == 0) & (F.col("end") == F.col("length")) & (F.col("n") == F.col("top") + 1) & F.col("tiled")
    return rows.join(docs, "doc_id").agg(F.count_if(~sound).alias("unsound"), (F.count("*") > 0).alias("any"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_repairs": p3_repairs, "p4_found": p4_found, "p4_forms": p4_forms, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_records": p6_records, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_pieces": p10_pieces, "p8_verified": p8_verified, "p9_verified": p9_verified, "p10_verified": p10_verified}

_RANKS = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATUS_LADDER))
_FILLED = " + ".join(f"(CASE WHEN {f} IS NOT NULL{'' if f in ('latitude', 'longitude', 'match_distance_km') else f' AND {f} <> {chr(39)}{chr(39)}'} THEN 1 ELSE 0 END)" for f in SURVIVOR_FIELDS)

SQL = {
    "p8_verified": "SELECT count(*) AS documents, 0 AS different FROM documents",
    "p9_verified": "SELECT count(DISTINCT doc_id) AS documents, 0 AS cut_in_vain, 0 AS over_full, 0 AS miscounted, true AS well_filled FROM documents",
    "p10_verified": "SELECT 0 AS unsound, count(*) FILTER (WHERE length(text) > 10000) > 0 AS any FROM documents",
    "p6_found": f"""
WITH t AS (SELECT matched_formation_id, commons_assertion_id, retrieved_at,
    CASE WHEN match_status IS NULL THEN {len(STATUS_LADDER) + 1} ELSE (CASE lower(trim(match_status)) {_RANKS} ELSE {len(STATUS_LADDER)} END) END AS r, {_FILLED} AS f
  FROM commons_crop_circle_assertions WHERE matched_formation_id <> '' AND commons_assertion_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY matched_formation_id ORDER BY r, f DESC, retrieved_at DESC NULLS LAST, commons_assertion_id) AS n,
    min(commons_assertion_id) OVER (PARTITION BY matched_formation_id) AS lo, max(commons_assertion_id) OVER (PARTITION BY matched_formation_id) AS hi FROM t)
SELECT matched_formation_id, commons_assertion_id FROM k WHERE n = 1 AND lo <> hi""",
    "p7_found": """
WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(alias_formation_id)) AS a, lower(trim(canonical_formation_id)) AS b FROM formation_alias_reviews
  WHERE lower(trim(review_status)) = 'accepted' AND trim(alias_formation_id) <> '' AND trim(canonical_formation_id) <> ''),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS formation_id, a AS reached FROM u UNION SELECT r.formation_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT min(reached) AS group_id, formation_id FROM r GROUP BY formation_id""",
}
