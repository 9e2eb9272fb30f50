"""Queries of choices, sequences, sets, nested values and checks over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.text import listed, normal
from meridian.operators import analytics, records, resolve
from meridian.runtime import table

# The match statuses that count as evidence.
_SURE = ("exact_place_and_date", "reviewed_same_event_later_documentation")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "commons_crop_circle_assertions").select("commons_assertion_id", "commons_image_id", "matched_formation_id", F.lower(F.trim("match_status")).alias("status"), "match_distance_km", "overlay_readiness", "candidate_count", "country_code", "date_iso").distinct()


def tier_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best picture of each formation: by status, then by nearness, then by id; and its tier's name."""
    rank = F.when(F.col("status").isin(*_SURE), 0).when(F.col("status").contains("place"), 1).otherwise(2)
    near = F.coalesce(F.when(~F.isnan("match_distance_km"), F.col("match_distance_km")), F.lit(1e9))
    rows = _pictures(spark, sf_dir).where("matched_formation_id <> ''")
    best = records.best_by(rows, ["matched_formation_id"], [("rank", rank), ("near", near)], ["commons_assertion_id"])
    return best.select("matched_formation_id", "commons_assertion_id", F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("rank") + 1).alias("tier"), F.when(F.col("near") < 1e9, F.round("near", 3)).alias("near"))


def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each index page's links counted by row and by different content; the largest content, one copy of each counted."""
    links = table(spark, sf_dir, "iccra_report_links_full").where("discovered_from IS NOT NULL")
    copies = links.where("sha256 <> ''").groupBy("discovered_from", "sha256").agg(F.max("bytes").alias("bytes"), F.min("url").alias("url"))
    best = records.best_by(copies, ["discovered_from"], [("less", -F.coalesce("bytes", F.lit(0))), ("sha", F.col("sha256"))], ["url"])
    counts = copies.groupBy("discovered_from").agg(F.count("*").alias("contents"))
    every = links.groupBy("discovered_from").agg(F.count("*").alias("rows"), F.count_if(F.col("http_status").startswith("2")).alias("fetched"))
    return every.join(counts, "discovered_from", "left").join(best, "discovered_from", "left").select("discovered_from", "rows", "fetched", F.coalesce("contents", F.lit(0)).alias("contents"), F.col("url").alias("largest_url"), (-F.col("less")).alias("largest_bytes"))


def status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any and whether all of a formation's pictures are sure, and the first of them by id."""
    rows = _pictures(spark, sf_dir).where("matched_formation_id <> ''")
    sure = F.coalesce(F.col("status").isin(*_SURE), F.lit(False))
    flags = rows.groupBy("matched_formation_id").agg(F.bool_or(sure).alias("any_sure"), F.bool_and(sure).alias("all_sure"), F.min("commons_assertion_id").alias("first_id"), F.min(F.when(sure, F.col("commons_assertion_id"))).alias("first_sure"))
    known = table(spark, sf_dir, "formations").select(F.col("formation_id").alias("matched_formation_id")).distinct()
    return known.join(flags, "matched_formation_id", "left").select("matched_formation_id", F.coalesce("any_sure", F.lit(False)).alias("any_sure"), F.coalesce("all_sure", F.lit(False)).alias("all_sure"), "first_id", "first_sure")


def error_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each country's matches in metres: their spread, the uncertainty with six root-sum-squared parts, and pass, downgrade or reject."""
    rows = _pictures(spark, sf_dir).where("country_code <> '' AND match_distance_km IS NOT NULL AND NOT isnan(match_distance_km)").withColumn("metres", F.col("match_distance_km") * 10)
    errors = analytics.error_summary(rows, ["country_code"], "metres")
    parts = F.array(*(F.lit(float(v)) for v in (1, 2, 2, 4, 0.5, 3)))
    root = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v))
    verdict = F.when(F.col("p95_error") <= 25, "pass").when(F.col("p95_error") <= 100, "downgrade").otherwise("reject")
    return errors.select("country_code", *(F.round(c, 4).alias(c) for c in ("median_error", "rmse", "max_error", "p95_error")), F.round(F.greatest("p95_error", "max_error") + root, 4).alias("uncertainty"), verdict.alias("verdict"))


def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of users' events: how many, how long, how many failed, and the share of the whole."""
    events = table(spark, sf_dir, "events")
    stages = events.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.sum("value"), 4).alias("seconds"), F.count_if(F.col("value") < 1).alias("failed"), F.round(F.max("value"), 4).alias("longest"))
    total = events.agg(F.sum("value").alias("total"))
    return stages.crossJoin(F.broadcast(total)).select("event_type", "runs", "seconds", "failed", "longest", F.round(F.col("seconds") / F.col("total"), 6).alias("share"))  # one row


def access_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the catalogue with its crawls, assertions and pages, noughts for those without."""
    runs = table(spark, sf_dir, "source_expansion_reconciliation").groupBy(F.concat(F.lit("src_"), "expansion_source_id").alias("source_id")).agg(F.count("*").alias("runs"), F.sum("yield.expansion_assertions").alias("promised"))
    told = table(spark, sf_dir, "source_assertions").groupBy("source_name").agg(F.count_distinct("assertion_id").alias("told"), F.count_distinct("source_page").alias("pages"), F.max("batch_no").alias("last_batch"))
    catalog = table(spark, sf_dir, "source_catalog").select("source_id", F.col("name").alias("source_name"), "access_status", "priority")
    joined = catalog.join(runs, "source_id", "left").join(told, "source_name", "left")
    return joined.select("source_id", "access_status", "priority", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("runs", "promised", "told", "pages")), "last_batch")


def score_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the first digit of their status, with what is fetched and whole."""
    links = table(spark, sf_dir, "iccra_report_links_full")
    group = F.coalesce(F.nullif(F.substring("http_status", 1, 1), F.lit("")), F.lit("none"))
    return links.groupBy(group.alias("status")).agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"), F.count_if(F.coalesce(F.col("http_status").startswith("2"), F.lit(False)) & (F.col("bytes") > 0) & (F.length("sha256") > 0)).alias("whole"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch: whether all rows have what they must, and how full the optional columns are."""
    rows = table(spark, sf_dir, "source_assertions")
    full = lambda c: F.round(F.avg(F.coalesce((F.col(c) != "").cast("double"), F.lit(0.0))), 6).alias(f"{c}_share")
    must = F.coalesce((F.col("assertion_id") != "") & (F.col("source_name") != "") & F.col("year").isNotNull(), F.lit(False))
    return rows.groupBy("batch_no").agg(F.bool_and(must).alias("complete"), *(full(c) for c in ("place", "region", "crop", "county", "notes")), F.array_join(F.array_sort(F.collect_set("date_precision")), ",").alias("precisions"))


def rows_and_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures by readiness: rows, different pictures, and how the sure ones spread over the statuses, as columns."""
    rows = _pictures(spark, sf_dir)
    names = ["exact_place_and_date", "place_and_year_candidate", "coordinate_and_date_candidate"]
    counts = rows.groupBy(F.coalesce("overlay_readiness", F.lit("")).alias("readiness"))
    return counts.agg(F.count("*").alias("rows"), F.count_distinct("commons_image_id").alias("pictures"), *(F.count_if(F.col("status") == n).alias(n) for n in names))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of a run in one row: rows, different ids, countries, pages, and pairs of source and country."""
    rows = table(spark, sf_dir, "source_assertions")
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("assertion_id").alias("assertions"), F.count_distinct(F.nullif("country_code", F.lit(""))).alias("countries"), F.count_distinct("source_page").alias("pages"), F.count_distinct("source_name", "country_code").alias("pairs"), F.min("retrieved_at").alias("first_at"), F.max("retrieved_at").alias("last_at"))


def slot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each different record on its index page, in the order of slots and addresses."""
    rows = table(spark, sf_dir, "source_assertions").where("source_page IS NOT NULL").groupBy("source_page", "source_record_url").agg(F.min(F.coalesce("source_slot", F.lit(0))).alias("first_slot"))
    at = Window.partitionBy("source_page").orderBy("first_slot", F.coalesce("source_record_url", F.lit("")))
    return rows.withColumn("slot", F.row_number().over(at))


def preferred_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the assertions of one record the reading to prefer: with a whole date, with a region, the longest place, the smallest id."""
    rows = table(spark, sf_dir, "source_assertions").where("source_record_url <> ''")
    order = [("undated", F.when(F.length("date_iso") == 10, 0).otherwise(1)), ("nowhere", F.when(F.col("region") != "", 0).otherwise(1)), ("short", -F.length(F.coalesce("place", F.lit("")))), ("assertion", F.col("assertion_id"))]
    return records.best_by(rows, ["source_record_url"], order, ["place", "date_iso"]).select("source_record_url", F.col("assertion").alias("assertion_id"), "place", "date_iso")


def quality_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as turns: each goes on as long as two of four daily figures improve and the first does not fall."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.max("value"), 3).alias("top"), F.count_distinct("event_type").alias("kinds"), F.round(F.min("value"), 3).alias("low"))
    return records.improving(days, "user_id", "day", ["n", "top", "kinds", "low"])


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error event with its number in its user's history and what came before and after it."""
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(at).alias("version"), F.lag("event_type").over(at).alias("before"), F.lead("event_type").over(at).alias("after"))
    return rows.where("event_type = 'error'")


def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ids of pictures' formations, alias reviews and formations lie to one another."""
    known = table(spark, sf_dir, "formations").select(F.col("formation_id").alias("id"))
    matched = table(spark, sf_dir, "commons_crop_circle_assertions").select(F.nullif("matched_formation_id", F.lit("")).alias("id"))
    alias = table(spark, sf_dir, "formation_alias_reviews").select(F.nullif(F.lower(F.trim("alias_formation_id")), F.lit("")).alias("id"))
    one = lambda name, a, b: records.sets(a, b, "id").withColumn("pair", F.lit(name))
    return one("matched in known", matched, known).unionByName(one("alias in known", alias, known)).unionByName(one("known in known", known, known))


def upserted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the large ones written anew and some that were not there."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    fresh = parts.where("p_size >= 45").select((F.col("p_partkey") + F.when(F.col("p_size") >= 48, 1_000_000).otherwise(0)).alias("p_partkey"), F.lit("fresh").alias("p_brand"), "p_size")
    return records.upsert(parts, fresh, "p_partkey", replace=True)


def reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each picture is no certain one: all reasons in order, and whether there are none."""
    why = records.reasons(
        (F.coalesce(F.col("matched_formation_id"), F.lit("")) == "", "no_formation"), (~F.coalesce(F.col("status").isin(*_SURE), F.lit(False)), "status_not_sure"), (F.isnan("match_distance_km") | F.col("match_distance_km").isNull(), "no_distance"),
        (F.col("match_distance_km") > 5, "far"), (F.coalesce("candidate_count", F.lit(0)) > 1, "ambiguous"), (F.length(F.coalesce("date_iso", F.lit(""))) < 10, "no_day"),
    )
    return _pictures(spark, sf_dir).select("commons_assertion_id", "matched_formation_id", F.array_join(why, ";").alias("reasons"), (F.size(why) == 0).alias("qualified")).distinct()


def parallel_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose delimited roles and their hashes are lists of one length, all hashes well formed."""
    links = table(spark, sf_dir, "iccra_report_links_full").select("url", listed(F.col("roles")).alias("roles"), F.transform(listed(F.col("roles")), lambda r: F.when(r.startswith("h"), F.sha1(r)).otherwise(F.substring(F.sha1(r), 1, 39))).alias("hashes")).distinct()
    good = F.forall("hashes", lambda h: h.rlike("^[0-9a-f]{40}$"))
    return links.select("url", F.size("roles").alias("roles"), ((F.size("roles") == F.size("hashes")) & good).alias("sound"))


def landmark_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control and check points made from each order's lines: different ids, disjoint sets, enough of each."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids"), F.array_sort(F.collect_list((F.col("l_partkey") % 7).cast("int"))).alias("parts"))
    controls, checks = F.filter("parts", lambda v: v < 4), F.filter("parts", lambda v: v >= 3)
    why = records.reasons((F.size(controls) < 2, "few_controls"), (F.size(checks) < 1, "few_checks"), (F.size(F.array_distinct(controls)) < F.size(controls), "repeated_control"), (F.arrays_overlap(controls, checks), "shared_point"))
    return lines.select("l_orderkey", F.size("ids").alias("lines"), F.array_join(why, ";").alias("reasons"))


def typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records read from JSON by their declared types, and summed up; what does not fit is null."""
    text = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "who": {"user": '), F.col("user_id").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}, "marks": ['), (F.col("event_id") % 3).cast("string"), F.lit(", "), (F.col("event_id") % 5).cast("string"), F.lit("]}"))
    rows = table(spark, sf_dir, "events").select(F.from_json(text, "id long, who struct<user: long, kind: string>, marks array<int>, none string").alias("j"))
    return rows.groupBy(F.col("j.who.kind").alias("kind")).agg(F.count("j.id").alias("n"), F.sum(F.aggregate("j.marks", F.lit(0), lambda s, v: s + v)).alias("marks"), F.count("j.none").alias("none"), F.max("j.who.user").alias("last_user"))


def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each country a map of its formations by crop, as sorted text, the counts made before the maps."""
    counts = table(spark, sf_dir, "formations").groupBy("country_code", F.coalesce(F.nullif("crop", F.lit("")), F.lit("unknown")).alias("crop")).agg(F.count_distinct("formation_id").alias("n"))
    return counts.where("country_code <> ''").groupBy("country_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("crop", "n"))), lambda e: F.concat_ws("=", e["crop"], e["n"].cast("string"))), ";").alias("crops"), F.sum("n").alias("formations"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a later state of the cache against the manifest: missing, of another size, or of other content."""
    links = resolve.keep_first(table(spark, sf_dir, "iccra_report_links_full").where("url IS NOT NULL").select("url", "bytes", "sha256", "retrieved_at"), ["url"], F.col("retrieved_at"), F.col("bytes"), F.col("sha256")).drop("retrieved_at")
    k = F.length("url") % 7
    found = links.where(k != 0).select("url", F.when(k == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(k == 2, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return records.matches_manifest(links, found, "url", "bytes", "sha256")


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of formations, and how often each of it does not."""
    rows = table(spark, sf_dir, "formations").withColumn("there", F.col("latitude").isNotNull() & ~F.isnan("latitude"))
    rules = {
        "position is whole": F.col("there") == (F.col("longitude").isNotNull() & ~F.isnan("longitude")), "latitude in range": ~F.col("there") | F.col("latitude").between(-90, 90), "method with position": ~F.col("there") | (F.coalesce("geocode_method", F.lit("")) != ""),
        "no method without": F.col("there") | (F.coalesce("geocode_method", F.lit("")) == ""), "uncertainty not negative": F.col("coordinate_uncertainty_km") >= 0, "date begins with year": F.substring("date_iso", 1, 4) == F.col("year").cast("string"), "month in range": F.col("month").between(1, 12), "sources counted": F.col("source_count") >= 1,
    }
    return records.violations(rows, "formation_id", rules)


def vocabulary_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review outcomes by their clean name, whether they are known ones, and how many lack a reviewer or a day."""
    status = F.lower(F.trim("review_status"))
    rows = table(spark, sf_dir, "formation_alias_reviews").groupBy(F.coalesce(status, F.lit("")).alias("status"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("reviewer"), F.lit("")) == "").alias("no_reviewer"), F.count_if(F.col("reviewed_at").isNull()).alias("no_day")).withColumn("known", F.col("status").isin("accepted", "rejected", "pending", "deferred"))


def partial_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one formation whose id holds a given piece, where there is just one."""
    ids = table(spark, sf_dir, "formations").select("formation_id")
    asked = ids.select(F.substring("formation_id", 5, 4).alias("piece")).distinct()
    return records.partial_reference(asked, ids, "piece", "formation_id")


def picture_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, links and placemarks as one table of addresses, with what each dialect lacks left null."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions")
    links = table(spark, sf_dir, "iccra_report_links_full")
    marks = table(spark, sf_dir, "legacy_kml_candidate_queue")
    every = records.union_types([
        ("picture", pictures, {"id": F.col("commons_assertion_id"), "url": F.col("commons_page_url"), "place": F.col("place"), "latitude": F.col("latitude")}), ("link", links, {"id": F.sha1("url"), "url": F.col("url"), "bytes": F.col("bytes")}),
        ("placemark", marks, {"id": F.col("legacy_candidate_id"), "place": F.col("placemark_name"), "latitude": F.col("latitude")}),
    ])
    return every.groupBy("source_kind").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count("url").alias("urls"), F.count("place").alias("places"), F.count(F.when(~F.isnan("latitude"), F.col("latitude"))).alias("placed"), F.sum("bytes").alias("bytes"))


def ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks in the order of the queue: priority, confidence, nearest duplicate groups first, name, id; their place in it."""
    rows = table(spark, sf_dir, "legacy_kml_candidate_queue").groupBy("legacy_candidate_id").agg(F.min(F.coalesce("priority_rank", F.lit(99))).alias("priority"), F.min(F.coalesce("confidence_tier", F.lit("~"))).alias("tier"), F.max(F.coalesce("possible_duplicate_group_size", F.lit(0))).alias("size"), F.min(F.coalesce("placemark_name", F.lit(""))).alias("name"))
    ranked = analytics.ranked(rows, F.col("priority"), F.col("tier"), F.desc("size"), F.col("name"), F.col("legacy_candidate_id"))
    return ranked.select("legacy_candidate_id", "priority", "tier", "rank")


def capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 formations a reader sees, by date and id, each with how many there are and whether more are left out."""
    rows = table(spark, sf_dir, "formations").where("date_iso <> '' AND country_code = 'GB'").groupBy("formation_id").agg(F.min("date_iso").alias("date_iso"))
    top = rows.orderBy("date_iso", "formation_id").limit(200)
    total = rows.agg(F.count("*").alias("total"))
    return top.crossJoin(F.broadcast(total)).withColumn("more", F.col("total") > 200)  # one row


def place_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over all columns' texts for a word, as an interface answers it: how many rows hold it, and the first 500 ids."""
    rows = table(spark, sf_dir, "formations").select("formation_id", F.lower(F.concat_ws(" ", "formation_id", "date_iso", "place", "region", "country", "county", "crop", "classification")).alias("all")).where(F.col("all").contains("wendshire")).select("formation_id").distinct()
    limit = max(1, min(500, 100_000))
    return rows.orderBy("formation_id").limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def atlas_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactive filter with all its conditions: words anywhere in seven columns, years, country, and lines only."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("formation_id", "place", "region", "country", "county", "crop", "classification"))))
    rows = table(spark, sf_dir, "formations").where(text.contains("down") & F.col("year").between(1990, 2015) & F.col("country_code").isin("GB", "US") & ~F.coalesce(F.col("orientation_status") == "rejected", F.lit(False)))
    return rows.select("formation_id", "place", "year", "country_code").distinct()


def lookup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's entry finds: the formation of that id, or else the first whose place holds the entry."""
    known = table(spark, sf_dir, "formations").groupBy("formation_id").agg(F.min(normal(F.coalesce("place", F.lit("")))).alias("p"))
    typed = table(spark, sf_dir, "commons_crop_circle_assertions").select(F.explode(F.array(F.col("matched_formation_id"), normal(F.col("place")))).alias("entry")).where("length(entry) >= 3").distinct()
    # By their files Spark takes these sides, a row for each run of letters, for far smaller than they are; neither is broadcast.
    exact = typed.join(known.hint("merge"), F.col("entry") == F.col("formation_id")).select("entry", F.lit(0).alias("tier"), "formation_id")
    runs = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - 2, F.lit(1))), lambda i: F.substring(F.col("p"), i, 3)))).alias("g")
    within = typed.withColumn("g", F.substring("entry", 1, 3)).join(known.where("p <> ''").select("formation_id", "p", runs).hint("merge"), "g").where(F.col("p").contains(F.col("entry"))).select("entry", F.lit(1).alias("tier"), "formation_id")
    return exact.unionByName(within).groupBy("entry").agg(F.min(F.struct("tier", "formation_id")).alias("s")).select("entry", "s.tier", "s.formation_id")


QUERIES = {f.__name__: f for f in (
    tier_choice, distinct_contents, status_flags, error_verdict, stage_rollup, access_summary, score_board, completeness, rows_and_kinds, run_summary, slot_numbers, preferred_parse, quality_steps, event_history, set_checks, upserted_parts,
    reason_lists, parallel_lists, landmark_checks, typed_json, count_maps, manifest_check, invariants, vocabulary_outcomes, partial_references, picture_dialects, ordered_output, capped_list, place_counts, atlas_filter, lookup_tiers,
)}

_P = "(SELECT DISTINCT commons_assertion_id, commons_image_id, matched_formation_id, lower(trim(match_status)) status, match_distance_km, overlay_readiness, candidate_count, country_code, date_iso FROM commons_crop_circle_assertions)"
_IN = "('exact_place_and_date', 'reviewed_same_event_later_documentation')"
_N = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
_SET = (lambda name, a, b: f"SELECT '{name}' AS pair, count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l AND r) AS shared, count(*) FILTER (WHERE l IS NULL) AS right_only FROM (SELECT DISTINCT id, true l FROM {a} WHERE id IS NOT NULL) x FULL JOIN (SELECT DISTINCT id, true r FROM {b} WHERE id IS NOT NULL) y USING (id)")
_KNOWN, _MATCHED, _ALIAS = "(SELECT formation_id id FROM formations)", "(SELECT nullif(matched_formation_id, '') id FROM commons_crop_circle_assertions)", "(SELECT nullif(lower(trim(alias_formation_id)), '') id FROM formation_alias_reviews)"
_FULL = (lambda c: f"round(avg(CASE WHEN {c} <> '' THEN 1.0 ELSE 0.0 END), 6) AS {c}_share")
_THERE = "(latitude IS NOT NULL AND NOT isnan(latitude))"
_RULES = {
    "position is whole": f"{_THERE} = (longitude IS NOT NULL AND NOT isnan(longitude))", "latitude in range": f"NOT {_THERE} OR latitude BETWEEN -90 AND 90", "method with position": f"NOT {_THERE} OR coalesce(geocode_method, '') <> ''", "no method without": f"{_THERE} OR coalesce(geocode_method, '') = ''",
    "uncertainty not negative": "coordinate_uncertainty_km >= 0", "date begins with year": "date_iso[1:4] = year::varchar", "month in range": "month BETWEEN 1 AND 12", "sources counted": "source_count >= 1",
}
SQL = {
    "tier_choice": f"""WITH r AS (SELECT *, CASE WHEN status IN {_IN} THEN 0 WHEN contains(status, 'place') THEN 1 ELSE 2 END k, coalesce(CASE WHEN NOT isnan(match_distance_km) THEN match_distance_km END, 1e9) near FROM {_P} WHERE matched_formation_id <> '')
SELECT matched_formation_id, commons_assertion_id, ['high', 'medium', 'low'][k + 1] AS tier, CASE WHEN near < 1e9 THEN round(near, 3) END AS near FROM (SELECT *, row_number() OVER (PARTITION BY matched_formation_id ORDER BY k, near, commons_assertion_id) n FROM r) WHERE n = 1""",
    "distinct_contents": """WITH l AS (SELECT * FROM iccra_report_links_full WHERE discovered_from IS NOT NULL), c AS (SELECT discovered_from, sha256, max(bytes) b, min(url) u FROM l WHERE sha256 <> '' GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY discovered_from ORDER BY coalesce(b, 0) DESC, sha256) n, count(*) OVER (PARTITION BY discovered_from) k FROM c)
SELECT l.discovered_from, count(*) AS rows, count(*) FILTER (WHERE http_status LIKE '2%') AS fetched, coalesce(any_value(t.k), 0) AS contents, any_value(t.u) AS largest_url, any_value(coalesce(t.b, 0)) FILTER (WHERE t.n = 1) AS largest_bytes FROM l LEFT JOIN t ON t.discovered_from = l.discovered_from AND t.n = 1 GROUP BY 1""",
    "status_flags": f"""WITH f AS (SELECT matched_formation_id, bool_or(coalesce(status IN {_IN}, false)) a, bool_and(coalesce(status IN {_IN}, false)) b, min(commons_assertion_id) c, min(CASE WHEN status IN {_IN} THEN commons_assertion_id END) d FROM {_P} WHERE matched_formation_id <> '' GROUP BY 1)
SELECT k.id AS matched_formation_id, coalesce(a, false) AS any_sure, coalesce(b, false) AS all_sure, c AS first_id, d AS first_sure FROM (SELECT DISTINCT formation_id id FROM formations) k LEFT JOIN f ON f.matched_formation_id = k.id""",
    "error_verdict": f"""WITH e AS (SELECT country_code, match_distance_km * 10 m FROM {_P} WHERE country_code <> '' AND NOT isnan(match_distance_km)), g AS (SELECT country_code, quantile_cont(m, 0.5) a, sqrt(avg(m * m)) b, max(m) c, quantile_cont(m, 0.95) d FROM e GROUP BY 1)
SELECT country_code, round(a, 4) AS median_error, round(b, 4) AS rmse, round(c, 4) AS max_error, round(d, 4) AS p95_error, round(greatest(c, d) + sqrt(34.25), 4) AS uncertainty, CASE WHEN d <= 25 THEN 'pass' WHEN d <= 100 THEN 'downgrade' ELSE 'reject' END AS verdict FROM g""",
    "stage_rollup": "WITH s AS (SELECT event_type, count(*) AS runs, round(sum(value), 4) AS seconds, count(*) FILTER (WHERE value < 1) AS failed, round(max(value), 4) AS longest FROM events GROUP BY 1) SELECT *, round(seconds / (SELECT sum(value) FROM events), 6) AS share FROM s",
    "access_summary": """WITH r AS (SELECT 'src_' || expansion_source_id id, count(*) n, sum(yield.expansion_assertions) p FROM source_expansion_reconciliation GROUP BY 1), t AS (SELECT source_name, count(DISTINCT assertion_id) told, count(DISTINCT source_page) pages, max(batch_no) last_batch FROM source_assertions GROUP BY 1)
SELECT source_id, access_status, priority, coalesce(r.n, 0) AS runs, coalesce(r.p, 0)::bigint AS promised, coalesce(told, 0) AS told, coalesce(pages, 0) AS pages, last_batch FROM source_catalog LEFT JOIN r ON r.id = source_id LEFT JOIN t ON t.source_name = name""",
    "score_board": "SELECT coalesce(nullif(substr(http_status, 1, 1), ''), 'none') AS status, count(*) AS rows, count(DISTINCT url) AS urls, count(*) FILTER (WHERE http_status LIKE '2%' AND bytes > 0 AND length(sha256) > 0) AS whole, sum(coalesce(bytes, 0))::bigint AS bytes FROM iccra_report_links_full GROUP BY 1",
    "completeness": f"SELECT batch_no, bool_and(coalesce(assertion_id <> '' AND source_name <> '' AND year IS NOT NULL, false)) AS complete, {', '.join(_FULL(c) for c in ('place', 'region', 'crop', 'county', 'notes'))}, coalesce(string_agg(DISTINCT date_precision, ',' ORDER BY date_precision), '') AS precisions FROM source_assertions GROUP BY 1",
    "rows_and_kinds": f"SELECT coalesce(overlay_readiness, '') AS readiness, count(*) AS rows, count(DISTINCT commons_image_id) AS pictures, count(*) FILTER (WHERE status = 'exact_place_and_date') AS exact_place_and_date, count(*) FILTER (WHERE status = 'place_and_year_candidate') AS place_and_year_candidate, count(*) FILTER (WHERE status = 'coordinate_and_date_candidate') AS coordinate_and_date_candidate FROM {_P} GROUP BY 1",
    "run_summary": "SELECT count(*) AS rows, count(DISTINCT assertion_id) AS assertions, count(DISTINCT nullif(country_code, '')) AS countries, count(DISTINCT source_page) AS pages, (SELECT count(*) FROM (SELECT DISTINCT source_name, country_code FROM source_assertions WHERE source_name IS NOT NULL AND country_code IS NOT NULL)) AS pairs, min(retrieved_at) AS first_at, max(retrieved_at) AS last_at FROM source_assertions",
    "slot_numbers": "WITH r AS (SELECT source_page, source_record_url, min(coalesce(source_slot, 0)) AS first_slot FROM source_assertions WHERE source_page IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY source_page ORDER BY first_slot, coalesce(source_record_url, '')) AS slot FROM r",
    "preferred_parse": "SELECT source_record_url, assertion_id, place, date_iso FROM (SELECT *, row_number() OVER (PARTITION BY source_record_url ORDER BY CASE WHEN length(date_iso) = 10 THEN 0 ELSE 1 END, CASE WHEN region <> '' THEN 0 ELSE 1 END, length(coalesce(place, '')) DESC, assertion_id) n FROM source_assertions WHERE source_record_url <> '') WHERE n = 1",
    "quality_steps": """WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) n, round(max(value), 3) top, count(DISTINCT event_type) kinds, round(min(value), 3) low FROM events GROUP BY 1, 2),
g AS (SELECT *, coalesce((n > lag(n) OVER w)::int + (top > lag(top) OVER w)::int + (kinds > lag(kinds) OVER w)::int + (low > lag(low) OVER w)::int < 2 OR n < lag(n) OVER w, false) AS fail FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
e AS (SELECT *, max(fail::int) OVER (PARTITION BY user_id ORDER BY day) AS ended FROM g) SELECT user_id, max(day) FILTER (WHERE ended = 0) AS best, count(*) AS turns, min(day) FILTER (WHERE ended = 1) AS stopped FROM e GROUP BY 1""",
    "event_history": "SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER w AS version, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error'",
    "set_checks": f"SELECT *, left_only = 0 AS subset, shared = 0 AS disjoint, left_only = 0 AND right_only = 0 AS equal FROM ({_SET('matched in known', _MATCHED, _KNOWN)} UNION ALL {_SET('alias in known', _ALIAS, _KNOWN)} UNION ALL {_SET('known in known', _KNOWN, _KNOWN)})",
    "upserted_parts": "WITH f AS (SELECT p_partkey + CASE WHEN p_size >= 48 THEN 1000000 ELSE 0 END AS p_partkey, 'fresh' AS p_brand, p_size FROM part WHERE p_size >= 45) SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f) UNION ALL SELECT * FROM f",
    "reason_lists": f"""WITH r AS (SELECT DISTINCT commons_assertion_id, matched_formation_id, list_filter([CASE WHEN coalesce(matched_formation_id, '') = '' THEN 'no_formation' END, CASE WHEN NOT coalesce(status IN {_IN}, false) THEN 'status_not_sure' END, CASE WHEN match_distance_km IS NULL OR isnan(match_distance_km) THEN 'no_distance' END,
 CASE WHEN match_distance_km > 5 THEN 'far' END, CASE WHEN coalesce(candidate_count, 0) > 1 THEN 'ambiguous' END, CASE WHEN length(coalesce(date_iso, '')) < 10 THEN 'no_day' END], lambda x: x IS NOT NULL) w FROM {_P}) SELECT commons_assertion_id, matched_formation_id, coalesce(array_to_string(w, ';'), '') AS reasons, len(w) = 0 AS qualified FROM r""",
    "parallel_lists": """WITH l AS (SELECT DISTINCT url, list_filter(list_transform(string_split(coalesce(roles, ''), ';'), lambda v: trim(v)), lambda v: v <> '') r FROM iccra_report_links_full) SELECT url, len(r)::int AS roles, len(list_filter(r, lambda v: NOT starts_with(v, 'h'))) = 0 AS sound FROM l""",
    "landmark_checks": """WITH l AS (SELECT l_orderkey, count(DISTINCT l_linenumber) lines, list((l_partkey % 7)::int) p FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, lines, list_filter(p, lambda v: v < 4) a, list_filter(p, lambda v: v >= 3) b FROM l)
SELECT l_orderkey, lines, coalesce(array_to_string(list_filter([CASE WHEN len(a) < 2 THEN 'few_controls' END, CASE WHEN len(b) < 1 THEN 'few_checks' END, CASE WHEN len(list_distinct(a)) < len(a) THEN 'repeated_control' END, CASE WHEN list_has_any(a, b) THEN 'shared_point' END], lambda x: x IS NOT NULL), ';'), '') AS reasons FROM s""",
    "typed_json": "SELECT event_type AS kind, count(*) AS n, sum(event_id % 3 + event_id % 5)::bigint AS marks, 0::bigint AS none, max(user_id) AS last_user FROM events GROUP BY 1",
    "count_maps": "WITH c AS (SELECT country_code, coalesce(nullif(crop, ''), 'unknown') crop, count(DISTINCT formation_id) n FROM formations WHERE country_code <> '' GROUP BY 1, 2) SELECT country_code, string_agg(crop || '=' || n, ';' ORDER BY crop) AS crops, sum(n)::bigint AS formations FROM c GROUP BY 1",
    "manifest_check": """WITH l AS (SELECT * FROM (SELECT url, bytes, sha256, row_number() OVER (PARTITION BY url ORDER BY retrieved_at NULLS FIRST, bytes NULLS FIRST, sha256 NULLS FIRST) n FROM iccra_report_links_full WHERE url IS NOT NULL) WHERE n = 1)
SELECT url, CASE WHEN length(url) % 7 = 0 THEN 'missing' WHEN length(url) % 7 = 1 THEN 'size' ELSE 'hash' END AS fault FROM l WHERE length(url) % 7 = 0 OR (length(url) % 7 = 1 AND bytes IS NOT NULL) OR (length(url) % 7 = 2 AND reverse(sha256) IS DISTINCT FROM sha256)""",
    "invariants": " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS broken, min(formation_id) FILTER (WHERE NOT ({c})) AS first_key FROM formations" for r, c in _RULES.items()),
    "vocabulary_outcomes": "SELECT coalesce(lower(trim(review_status)), '') AS status, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(reviewer), '') = '') AS no_reviewer, count(*) FILTER (WHERE reviewed_at IS NULL) AS no_day, coalesce(lower(trim(review_status)), '') IN ('accepted', 'rejected', 'pending', 'deferred') AS known FROM formation_alias_reviews GROUP BY 1, 5",
    "partial_references": """WITH i AS (SELECT DISTINCT formation_id FROM formations), a AS (SELECT DISTINCT substr(formation_id, 5, 4) piece FROM i), h AS (SELECT piece, count(*) n, min(formation_id) f FROM a JOIN i ON contains(formation_id, piece) GROUP BY 1) SELECT piece, CASE WHEN n = 1 THEN f END AS formation_id, n AS matches FROM h""",
    "picture_dialects": """SELECT 'picture' AS source_kind, count(*) AS rows, count(DISTINCT commons_assertion_id) AS ids, count(commons_page_url) AS urls, count(place) AS places, count(CASE WHEN NOT isnan(latitude) THEN 1 END) AS placed, NULL::bigint AS bytes FROM commons_crop_circle_assertions
UNION ALL SELECT 'link', count(*), count(DISTINCT sha1(url)), count(url), 0, 0, sum(bytes)::bigint FROM iccra_report_links_full UNION ALL SELECT 'placemark', count(*), count(DISTINCT legacy_candidate_id), 0, count(placemark_name), count(CASE WHEN NOT isnan(latitude) THEN 1 END), NULL FROM legacy_kml_candidate_queue""",
    "ordered_output": """WITH r AS (SELECT legacy_candidate_id, min(coalesce(priority_rank, 99)) priority, min(coalesce(confidence_tier, '~')) tier, max(coalesce(possible_duplicate_group_size, 0)) size, min(coalesce(placemark_name, '')) name FROM legacy_kml_candidate_queue GROUP BY 1)
SELECT legacy_candidate_id, priority, tier, row_number() OVER (ORDER BY priority, tier, size DESC, name, legacy_candidate_id) AS rank FROM r""",
    "capped_list": "WITH r AS (SELECT formation_id, min(date_iso) date_iso FROM formations WHERE date_iso <> '' AND country_code = 'GB' GROUP BY 1), t AS (SELECT count(*) total FROM r) SELECT formation_id, date_iso, total, total > 200 AS more FROM r, t ORDER BY date_iso, formation_id LIMIT 200",
    "place_counts": "WITH r AS (SELECT DISTINCT formation_id FROM formations WHERE contains(lower(concat_ws(' ', formation_id, date_iso, place, region, country, county, crop, classification)), 'wendshire')), t AS (SELECT count(*) total FROM r) SELECT formation_id, total FROM r, t ORDER BY formation_id LIMIT 500",
    "atlas_filter": "SELECT DISTINCT formation_id, place, year, country_code FROM formations WHERE contains(lower(concat_ws(' ', formation_id, coalesce(place, ''), coalesce(region, ''), coalesce(country, ''), coalesce(county, ''), coalesce(crop, ''), coalesce(classification, ''))), 'down') AND year BETWEEN 1990 AND 2015 AND country_code IN ('GB', 'US') AND NOT coalesce(orientation_status = 'rejected', false)",
    "lookup_tiers": f"""WITH k AS (SELECT formation_id, min({_N("coalesce(place, '')")}) p FROM formations GROUP BY 1), t AS (SELECT DISTINCT unnest([matched_formation_id, {_N("place")}]) entry FROM commons_crop_circle_assertions),
h AS (SELECT entry, CASE WHEN entry = formation_id THEN 0 ELSE 1 END tier, formation_id FROM t JOIN k ON entry = formation_id OR contains(p, entry) WHERE length(entry) >= 3) SELECT entry, tier, formation_id FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY tier, formation_id) n FROM h) WHERE n = 1""",
}
