"""Queries of the keyed, matching, aggregating and auditing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.text import flag, given, jaccard, listed, normal, stable_id, tokens
from meridian.operators import analytics, audit, match, resolve
from meridian.runtime import table

_NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_assertions")


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of assertions by year, month, day, place, region and country: first values, last crops, sorted sets."""
    rows = resolve.keep_first(_assertions(spark, sf_dir), ["assertion_id"], F.col("batch_no"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = [text("year").alias("k_year"), text("month").alias("k_month"), text("day").alias("k_day"), normal(text("place")).alias("k_place"), normal(text("region")).alias("k_region"), text("country_code").alias("k_country")]
    keyed = rows.select("*", *key)
    order = F.struct("batch_no", "assertion_id")
    names = ["k_year", "k_month", "k_day", "k_place", "k_region", "k_country"]
    groups = keyed.groupBy(*names).agg(
        resolve.first_present("place", order).alias("place"), resolve.first_present("county", order).alias("county"), resolve.first_present("crop", order).alias("crop"),
        resolve.last_present("size_text", order, F.col("source_name") == "Harvest Marks Centre").alias("archive_size"), resolve.joined_set(F.col("source_name")).alias("source_names"),
        F.min("assertion_id").alias("first_id"), F.count("*").alias("source_count"), F.min_by("classification", F.struct("batch_no", "assertion_id")).alias("first_classification"),
    )
    return groups.select(stable_id("cc_", *map(F.col, names), length=12).alias("entity_id"), "place", "county", "crop", "archive_size", "source_names", "first_id", "source_count", "first_classification")


def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest event of each user and type."""
    events = table(spark, sf_dir, "events")
    return resolve.keep_first(events, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


def keep_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fetch of each link, in the order in which links appeared first."""
    links = table(spark, sf_dir, "iccra_report_links_full")
    last = F.max_by(F.struct("http_status", "bytes"), F.struct("retrieved_at", F.coalesce("sha256", F.lit("")))).alias("last")
    return links.groupBy("url").agg(F.min("retrieved_at").alias("first_seen"), last).select("url", "first_seen", F.col("last.http_status").alias("http_status"), F.col("last.bytes").alias("bytes"))


def best_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page's snapshots the successful one of most bytes."""
    links = table(spark, sf_dir, "iccra_report_links_full")
    order = [F.coalesce(F.col("http_status").startswith("2"), F.lit(False)).desc(), F.col("bytes").desc_nulls_last(), F.col("url")]
    return resolve.keep_first(links, ["discovered_from"], *order).select("discovered_from", "url", "bytes")


def strict_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part with the greatest quantity of each supplier, where no other part shares it."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return resolve.strict_best(sums, ["l_suppkey"], "quantity", "l_partkey")


def ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures against formations of their country and year: equal place and date, then place and year; all of the best tier."""
    pictures = resolve.keep_first(table(spark, sf_dir, "commons_crop_circle_assertions"), ["commons_assertion_id"], F.col("retrieved_at"))
    pictures = pictures.select("commons_assertion_id", normal(F.col("place")).alias("p"), F.col("date_iso").alias("d"), F.substring("date_iso", 1, 4).alias("y"), F.col("country_code").alias("cc")).where("p <> '' AND y <> ''")
    formations = table(spark, sf_dir, "formations").select("formation_id", normal(F.col("place")).alias("p"), F.col("date_iso").alias("fd"), F.substring("date_iso", 1, 4).alias("y"), F.col("country_code").alias("fcc")).distinct()
    pairs = pictures.join(formations, ["p", "y"]).where(F.col("cc").isNull() | F.col("fcc").isNull() | (F.col("cc") == F.col("fcc")))
    pairs = pairs.withColumn("tier", F.when(F.col("d") == F.col("fd"), 0).otherwise(1))
    return resolve.top_tier(pairs, ["commons_assertion_id"], "tier").select("commons_assertion_id", "formation_id", "tier", "candidates")


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later assertions against the accepted history: exact key, date and place, date and alternate place, else new."""
    rows = resolve.keep_first(_assertions(spark, sf_dir), ["assertion_id"], F.col("batch_no"))
    late, known = rows.where("batch_no > 0"), rows.where("batch_no = 0")
    date, place, region, cc = F.col("date_iso"), normal(F.col("place")), normal(F.coalesce("region", F.lit(""))), F.coalesce("country_code", F.lit(""))
    other = normal(given(F.col("alternate_place")))
    tiers = [("exact_overlap", [date, place, region, cc], [date, place, region, cc]), ("same_date_and_place", [date, place], [date, place]), ("alias_overlap_not_merged", [date, other], [date, place])]
    known = known.withColumn("match_id", F.col("assertion_id"))
    return match.cascade(late, known.select("match_id", "date_iso", "place", "region", "country_code"), "assertion_id", "match_id", tiers)


def token_jaccard_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of one date and country whose names share a third of their words or more."""
    rows = _assertions(spark, sf_dir).select("assertion_id", "date_iso", "country_code", F.filter(tokens(F.col("place")), lambda w: w != "").alias("w")).distinct()
    return match.similar_sets(rows, "assertion_id", ["date_iso", "country_code"], "w", 0.33)


def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers after every fourth is folded into the one before it, with their parts' brands together."""
    supplied = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(resolve.joined_set(F.col("p_brand")).alias("brands"))
    suppliers = table(spark, sf_dir, "supplier").join(supplied, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("brands", F.lit("")).alias("brands"))
    aliases = suppliers.where(F.col("s_suppkey") % 4 == 0).select(F.col("s_suppkey").alias("alias"), (F.col("s_suppkey") - 1).alias("canonical"))
    merged = resolve.merge_aliases(suppliers, aliases, "s_suppkey", ["brands"])
    return merged.select("s_suppkey", "s_name", F.array_join(F.array_sort(F.split("brands", "; ")), "; ").alias("brands"))


def override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations with the crop that assertions of their key give, curated before generated."""
    formations = resolve.keep_first(table(spark, sf_dir, "formations"), ["formation_id"], F.col("date_iso"))
    key = [F.col("date_iso"), normal(F.col("place")).alias("p")]
    crops = _assertions(spark, sf_dir).where("crop <> ''").groupBy(*key).agg(F.min_by("crop", F.struct("batch_no", "assertion_id")).alias("told"))
    joined = formations.select("formation_id", "crop", *key).join(crops, ["date_iso", "p"], "left")
    return joined.select("formation_id", F.coalesce(given(F.col("crop")), F.col("told")).alias("crop"), F.when(given(F.col("crop")).isNotNull(), "own").when(F.col("told").isNotNull(), "told").otherwise("none").alias("origin"))


def link_union_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their later corrections by priority, the last table's row for a customer and day."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("orderkey"), F.max("o_orderpriority").alias("priority"))
    changed = orders.where(F.col("o_custkey") % 3 == 0).withColumn("priority", F.lit("0-CHANGED"))
    return resolve.last_wins([orders, changed], ["o_custkey", "day"]).select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "orderkey", "priority")


def managed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts where those of size over 40 are generated anew."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("int").alias("p_size"))
    fresh = parts.where("p_size > 40").withColumn("p_size", F.lit(0))
    return resolve.replace_managed(parts, fresh, "p_partkey")


def fk_explode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each role from the delimited roles of links."""
    links = table(spark, sf_dir, "iccra_report_links_full").select("url", F.explode(listed(F.col("roles"))).alias("role")).distinct()
    return links.groupBy("role").agg(F.count("*").alias("urls"), F.min("url").alias("first_url"))


def image_count_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different pictures of each formation, over its own id and the aliases accepted for it."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").where("matched_formation_id <> ''").select(F.col("matched_formation_id").alias("id"), "commons_image_id")
    clean = lambda c: given(F.lower(c))
    reviews = table(spark, sf_dir, "formation_alias_reviews").where(F.lower(F.trim("review_status")) == "accepted").select(clean("alias_formation_id").alias("id"), clean("canonical_formation_id").alias("to")).where("id <> to").distinct()
    moved = pictures.join(reviews, "id").select(F.col("to").alias("id"), "commons_image_id")
    return pictures.unionByName(moved).groupBy("id").agg(F.count_distinct("commons_image_id").alias("pictures")).withColumnRenamed("id", "formation_id")


def fill_missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without assertion, of as many as a season's index page promises: its greatest slot."""
    rows = _assertions(spark, sf_dir).where("source_slot > 0 AND source_page IS NOT NULL")
    promised = rows.groupBy("source_page").agg(F.max("source_slot").alias("promised"))
    return resolve.filled_slots(promised, ["source_page"], "promised").join(rows.select("source_page", F.col("source_slot").alias("slot")).distinct(), ["source_page", "slot"], "left_anti")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl batches whose spans of retrieval overlap in one source."""
    spans = _assertions(spark, sf_dir).where("crawl_run_id IS NOT NULL AND retrieved_at IS NOT NULL").groupBy("source_name", "crawl_run_id").agg(F.to_date(F.min("retrieved_at")).alias("lo"), F.to_date(F.max("retrieved_at")).alias("hi"))
    other = spans.select("source_name", F.col("crawl_run_id").alias("other_run"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return match.interval_join(spans, other, ["source_name"], "lo", "hi", "lo2", "hi2").where("crawl_run_id < other_run").select("source_name", "crawl_run_id", "other_run")


def work_queue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations in one total order of evidence: sources, then position's certainty, then id."""
    rows = resolve.keep_first(table(spark, sf_dir, "formations"), ["formation_id"], F.col("date_iso"))
    score = (F.coalesce("source_count", F.lit(0)) * 10 + F.when(F.col("latitude").isNotNull(), 5).otherwise(0)).alias("score")
    return analytics.ranked(rows.select("formation_id", "country_code", score), F.desc("score"), F.col("formation_id"))


def marginal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each value of four columns of formations, in one pass."""
    return analytics.marginals(table(spark, sf_dir, "formations"), ["country_code", "geocode_method", "orientation_status", "classification"])


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formations by country and method, by each alone, and in all."""
    rows = table(spark, sf_dir, "formations").select(F.coalesce("country_code", F.lit("-")).alias("country_code"), F.coalesce("geocode_method", F.lit("-")).alias("method"))
    return rows.cube("country_code", "method").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that sums up the formations."""
    return table(spark, sf_dir, "formations").agg(
        F.count("formation_id").alias("rows_with_id"), F.count_distinct("formation_id").alias("formations"), F.count_if(F.col("country_code") == "US").alias("in_us"), F.count_if(F.col("latitude").isNotNull()).alias("placed"),
        F.min("date_iso").alias("first_date"), F.max("date_iso").alias("last_date"), F.sum("source_count").alias("sources"),
    )


def top_n_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 countries with most formations."""
    counts = table(spark, sf_dir, "formations").where("country_code <> ''").groupBy("country_code").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "country_code").limit(15)


def conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different links by source page's kind: fetched, failed, and those never fetched well."""
    links = table(spark, sf_dir, "iccra_report_links_full").withColumn("kind", F.regexp_extract("url", r"^https?://[^/]+/([^/]+)/", 1))
    ok = F.coalesce(F.col("http_status").startswith("2"), F.lit(False))
    per = links.groupBy("kind", "url").agg(F.bool_or(ok).alias("ever"), F.bool_or(~ok).alias("failed"))
    return per.groupBy("kind").agg(F.count("*").alias("urls"), F.count_if("ever").alias("fetched"), F.count_if("failed").alias("failed"), F.count_if(~F.col("ever")).alias("never"))


def source_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions, different keys, and keys that lower batches have, of every catalogued source; zero where it has none."""
    key = F.concat_ws("|", F.coalesce("date_iso", F.lit("")), normal(F.coalesce("place", F.lit(""))), normal(F.coalesce("region", F.lit(""))), F.coalesce("country_code", F.lit(""))).alias("key")
    rows = _assertions(spark, sf_dir).select("source_name", "batch_no", "assertion_id", key)
    first = rows.groupBy("key").agg(F.min("batch_no").alias("first_batch"))
    per = rows.join(first, "key").groupBy("source_name").agg(F.count_distinct("assertion_id").alias("assertions"), F.count_distinct("key").alias("keys"), F.count_distinct(F.when(F.col("first_batch") < F.col("batch_no"), F.col("key"))).alias("overlapping"))
    catalog = table(spark, sf_dir, "source_catalog").select(F.col("name").alias("source_name")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return catalog.join(per, "source_name", "left").select("source_name", zero("assertions"), zero("keys"), zero("overlapping"))


def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the history, of later batches, in both, and in one only."""
    rows = _assertions(spark, sf_dir).select("batch_no", F.concat_ws("|", F.coalesce("date_iso", F.lit("")), normal(F.coalesce("place", F.lit("")))).alias("key"))
    per = rows.groupBy("key").agg(F.bool_or(F.col("batch_no") == 0).alias("old"), F.bool_or(F.col("batch_no") > 0).alias("new"))
    return per.agg(F.count_if("old").alias("history"), F.count_if("new").alias("later"), F.count_if(F.col("old") & F.col("new")).alias("both"), F.count_if(F.col("old") != F.col("new")).alias("one_only"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated against counted assertions of each crawl run, with the difference; runs of either side."""
    stated = table(spark, sf_dir, "source_expansion_reconciliation").select("crawl_run_id", F.col("yield.expansion_assertions").alias("stated"))
    counted = _assertions(spark, sf_dir).where("crawl_run_id IS NOT NULL").groupBy("crawl_run_id").agg(F.count_distinct("assertion_id").alias("counted"))
    return stated.join(counted, "crawl_run_id", "full").select("crawl_run_id", "stated", "counted", (F.coalesce("counted", F.lit(0)) - F.col("stated")).alias("difference"))


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well an exact earlier status says that a picture's date is its formation's, by country."""
    pictures = table(spark, sf_dir, "commons_crop_circle_assertions").select(F.col("matched_formation_id").alias("formation_id"), F.col("date_iso").alias("pd"), F.lower(F.trim("match_status")).alias("s"), "commons_assertion_id").distinct()
    formations = resolve.keep_first(table(spark, sf_dir, "formations"), ["formation_id"], F.col("date_iso")).select("formation_id", "date_iso", "country_code")
    return analytics.confusion(pictures.join(formations, "formation_id"), F.coalesce(F.col("pd") == F.col("date_iso"), F.lit(False)), F.coalesce(F.col("s") == "exact_place_and_date", F.lit(False)), ["country_code"])


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts' spread by ship month: median, RMSE, greatest, 95th percentile."""
    rows = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_discount") * 100).alias("e"))
    return analytics.error_summary(rows, ["month"], "e").select("month", *(F.round(c, 4).alias(c) for c in ("median_error", "rmse", "max_error", "p95_error")))


def axis_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean axis and deviation of each supplier's lines, weighted by quantity."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 37 % 60 + 20).cast("double").alias("a"), F.col("l_quantity").alias("w"))
    return analytics.axial_mean(rows, ["l_suppkey"], "a", "w").select("l_suppkey", F.round("axis_mean", 4).alias("axis_mean"), F.round("axis_deviation", 4).alias("axis_deviation"), "n")


def segment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of each supplier's axes."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 37 % 180).cast("double").alias("a"), F.col("l_quantity").alias("w"))
    return analytics.segment_clusters(rows, ["l_suppkey"], "a", "w")


def reference_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page together: all roles, the longest anchor, the largest size."""
    links = table(spark, sf_dir, "iccra_report_links_full").where("discovered_from IS NOT NULL")
    roles = links.select("discovered_from", F.explode(listed(F.col("roles"))).alias("role")).distinct().groupBy("discovered_from").agg(resolve.joined_set(F.col("role")).alias("roles"))
    best = links.groupBy("discovered_from").agg(F.min(F.struct((-F.length(F.coalesce("anchor_text", F.lit("")))).alias("l"), F.coalesce("anchor_text", F.lit("")).alias("t"))).alias("a"), F.max("bytes").alias("largest"))
    return best.join(roles, "discovered_from", "left").select("discovered_from", F.length("a.t").alias("longest_anchor"), "largest", F.coalesce("roles", F.lit("")).alias("roles"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase of its user before it or itself."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return analytics.carried(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "purchase", F.col("event_id"))).select("event_id", F.col("carried").alias("last_purchase"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event type of every user, and the number of changes before it."""
    rows = table(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = rows.select("user_id", "ts", "event_id", "event_type", F.lag("event_type").over(at).alias("before"))
    return steps.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("before") != F.col("event_type")).alias("changes"))


def fk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, missing keys and orphans of the references between tables."""
    t = lambda n: table(spark, sf_dir, n)
    return audit.foreign_keys({
        "picture_formation": (t("commons_crop_circle_assertions"), "matched_formation_id", t("formations"), "formation_id"), "assertion_source": (t("source_assertions"), "source_name", t("source_catalog"), "name"),
        "alias_canonical": (t("formation_alias_reviews"), "canonical_formation_id", t("formations"), "formation_id"), "order_customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"),
    })


def uniqueness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, keys and repeated keys of five tables."""
    keys = {"source_assertions": "assertion_id", "formations": "formation_id", "commons_crop_circle_assertions": "commons_assertion_id", "legacy_kml_candidate_queue": "legacy_candidate_id", "iccra_report_links_full": "url"}
    return audit.uniqueness({n: (table(spark, sf_dir, n), k) for n, k in keys.items()})


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks by what keeps them from the map."""
    rows = table(spark, sf_dir, "legacy_kml_candidate_queue")
    lat, lon = F.col("latitude"), F.col("longitude")
    why = F.when(lat.isNull() | lon.isNull(), "no_position").when((F.abs(lat) > 90) | (F.abs(lon) > 180), "impossible").when((lat == 0) & (lon == 0), "placeholder").otherwise("usable")
    return rows.groupBy(why.alias("outcome")).agg(F.count("*").alias("rows"), F.count_distinct("legacy_candidate_id").alias("candidates"))


def alias_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted aliases that are named twice, or that are canonical for others: what a plain fold would get wrong."""
    clean = lambda c: given(F.lower(c))
    rows = table(spark, sf_dir, "formation_alias_reviews").where(F.lower(F.trim("review_status")) == "accepted").select(clean("alias_formation_id").alias("a"), clean("canonical_formation_id").alias("c")).where("a <> c").distinct()
    sides = rows.select(F.col("a").alias("id"), F.lit(1).alias("as_alias"), F.lit(0).alias("as_canonical")).unionByName(rows.select(F.col("c").alias("id"), F.lit(0).alias("as_alias"), F.lit(1).alias("as_canonical")))
    per = sides.groupBy("id").agg(F.sum("as_alias").alias("named"), F.sum("as_canonical").alias("canonical_for"))
    return per.where("named > 1 OR (named > 0 AND canonical_for > 0)").select("id", "named", "canonical_for")


def geocode_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places looked up by whole name, all but the last word, and first word: the first variant that is known, its best source."""
    rows = resolve.keep_first(_assertions(spark, sf_dir), ["assertion_id"], F.col("batch_no")).select("assertion_id", F.coalesce("country_code", F.lit("")).alias("cc"), normal(F.regexp_replace("place", "[/;].*$", "")).alias("whole"))
    words = F.split("whole", " ")
    variants = F.array(F.col("whole"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "), F.element_at(words, 1))
    asked = rows.where("whole <> ''").select("assertion_id", "cc", F.posexplode(variants).alias("variant", "name")).where("name <> ''")
    known = table(spark, sf_dir, "formations").where("latitude IS NOT NULL AND NOT isnan(latitude)").select("formation_id", F.coalesce("country_code", F.lit("")).alias("cc"), normal(F.col("place")).alias("name"), F.coalesce("source_count", F.lit(0)).alias("weight")).distinct()
    best = known.groupBy("cc", "name").agg(F.min(F.struct((-F.col("weight")).alias("w"), "formation_id")).alias("b"))
    hits = asked.join(best, ["cc", "name"]).groupBy("assertion_id").agg(F.min(F.struct("variant", "b.formation_id")).alias("h"))
    return hits.select("assertion_id", "h.variant", "h.formation_id")


def certified_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, once its certificate (twelve unique sources) holds."""
    rows = audit.certified(table(spark, sf_dir, "source_catalog"), "source_id", 12, ["source_id", "name", "url"])
    return rows.select("source_id", "name")


def lenient_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias reviews by status as a lenient flag, with pairs that are reversed somewhere."""
    rows = table(spark, sf_dir, "formation_alias_reviews").select(given(F.lower("alias_formation_id")).alias("a"), given(F.lower("canonical_formation_id")).alias("c"), flag(F.when(F.lower(F.trim("review_status")) == "accepted", "yes")).alias("ok")).distinct()
    back = rows.select(F.col("a").alias("c"), F.col("c").alias("a"), F.lit(True).alias("reversed")).distinct()
    return rows.join(back, ["a", "c"], "left").groupBy("ok").agg(F.count("*").alias("pairs"), F.count_if(F.coalesce("reversed", F.lit(False))).alias("reversed_pairs"), F.count_if(F.col("a") == F.col("c")).alias("self_pairs"))


QUERIES = {f.__name__: f for f in (
    entity_resolution, keep_first_dedup, keep_last_dedup, best_snapshot, strict_best_match, ranked_match, match_cascade, token_jaccard_block, alias_merge, override_resolution, link_union_last_wins, managed_replace,
    fk_explode_index, image_count_union, fill_missing_slots, interval_overlap, work_queue_rank, marginal_counts, grouping_sets, summary_counts, top_n_counts, conditional_distinct, source_yield, set_overlap, reconciliation,
    confusion_metrics, error_summary, axis_mean, segment_clusters, reference_merge, carry_forward, latest_state, fk_audit, uniqueness_audit, coverage_audit, certified_scan, lenient_flags, alias_guard, geocode_variants,
)}

_A1 = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assertion_id ORDER BY batch_no) AS rn FROM source_assertions) WHERE rn = 1)"
_N = _NORM.format
SQL = {
    "entity_resolution": f"""
WITH k AS (SELECT *, coalesce(cast(year AS varchar), '') k1, coalesce(cast(month AS varchar), '') k2, coalesce(cast(day AS varchar), '') k3, {_N("coalesce(place, '')")} k4, {_N("coalesce(region, '')")} k5, coalesce(country_code, '') k6 FROM {_A1})
SELECT 'cc_' || substr(sha1(concat_ws('|', k1, k2, k3, k4, k5, k6)), 1, 12) AS entity_id, arg_min(place, (batch_no, assertion_id)) FILTER (WHERE place <> '') AS place,
 arg_min(county, (batch_no, assertion_id)) FILTER (WHERE county <> '') AS county, arg_min(crop, (batch_no, assertion_id)) FILTER (WHERE crop <> '') AS crop,
 arg_max(size_text, (batch_no, assertion_id)) FILTER (WHERE source_name = 'Harvest Marks Centre' AND size_text <> '') AS archive_size, coalesce(string_agg(DISTINCT source_name, '; ' ORDER BY source_name) FILTER (WHERE source_name <> ''), '') AS source_names,
 min(assertion_id) AS first_id, count(*) AS source_count, arg_min(classification, (batch_no, assertion_id)) AS first_classification FROM k GROUP BY k1, k2, k3, k4, k5, k6""",
    "keep_first_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn = 1",
    "keep_last_dedup": "SELECT url, min(retrieved_at) AS first_seen, arg_max_null(http_status, (retrieved_at, coalesce(sha256, ''))) AS http_status, arg_max_null(bytes, (retrieved_at, coalesce(sha256, ''))) AS bytes FROM iccra_report_links_full GROUP BY url",
    "best_snapshot": "SELECT discovered_from, url, bytes FROM (SELECT *, row_number() OVER (PARTITION BY discovered_from ORDER BY coalesce(http_status LIKE '2%', false) DESC, bytes DESC NULLS LAST, url) rn FROM iccra_report_links_full) WHERE rn = 1",
    "strict_best_match": """WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2), r AS (SELECT *, max(quantity) OVER (PARTITION BY l_suppkey) m FROM s), t AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) c FROM r WHERE quantity = m)
SELECT l_suppkey, l_partkey, quantity FROM t WHERE c = 1""",
    "ranked_match": f"""
WITH p AS (SELECT DISTINCT commons_assertion_id, {_N("place")} p, date_iso d, substr(date_iso, 1, 4) y, country_code cc FROM commons_crop_circle_assertions WHERE {_N("place")} <> '' AND date_iso <> ''),
f AS (SELECT DISTINCT formation_id, {_N("place")} p, date_iso fd, substr(date_iso, 1, 4) y, country_code fcc FROM formations),
j AS (SELECT commons_assertion_id, formation_id, CASE WHEN d = fd THEN 0 ELSE 1 END AS tier FROM p JOIN f USING (p, y) WHERE cc IS NULL OR fcc IS NULL OR cc = fcc),
m AS (SELECT *, min(tier) OVER (PARTITION BY commons_assertion_id) t FROM j)
SELECT commons_assertion_id, formation_id, tier, count(*) OVER (PARTITION BY commons_assertion_id) AS candidates FROM m WHERE tier = t""",
    "match_cascade": f"""
WITH a AS (SELECT *, {_N("place")} p, {_N("coalesce(region, '')")} r, coalesce(country_code, '') cc, {_N("nullif(trim(alternate_place), '')")} o FROM {_A1}),
t1 AS (SELECT date_iso, p, r, cc, min(assertion_id) lo FROM a WHERE batch_no = 0 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT assertion_id) = 1),
t2 AS (SELECT date_iso, p, min(assertion_id) lo FROM a WHERE batch_no = 0 GROUP BY 1, 2 HAVING count(DISTINCT assertion_id) = 1)
SELECT a.assertion_id, coalesce(t1.lo, t2.lo, t3.lo) AS match_id, CASE WHEN t1.lo IS NOT NULL THEN 'exact_overlap' WHEN t2.lo IS NOT NULL THEN 'same_date_and_place' WHEN t3.lo IS NOT NULL THEN 'alias_overlap_not_merged' ELSE 'new' END AS tier
FROM a LEFT JOIN t1 ON a.date_iso = t1.date_iso AND a.p = t1.p AND a.r = t1.r AND a.cc = t1.cc LEFT JOIN t2 ON a.date_iso = t2.date_iso AND a.p = t2.p LEFT JOIN t2 t3 ON a.date_iso = t3.date_iso AND a.o = t3.p WHERE a.batch_no > 0""",
    "token_jaccard_block": f"""
WITH f AS (SELECT DISTINCT assertion_id, date_iso, country_code, list_distinct(list_filter(string_split({_N("place")}, ' '), lambda x: x <> '')) w FROM source_assertions),
j AS (SELECT a.assertion_id, b.assertion_id AS other_id, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0)::double, 0), 6) AS similarity FROM f a JOIN f b ON a.date_iso = b.date_iso AND a.country_code = b.country_code AND a.assertion_id < b.assertion_id)
SELECT DISTINCT * FROM j WHERE similarity >= 0.33""",
    "alias_merge": """
WITH b AS (SELECT DISTINCT CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey - 1 ELSE l_suppkey END AS s, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> '')
SELECT s_suppkey, s_name, coalesce((SELECT string_agg(p_brand, '; ' ORDER BY p_brand) FROM b WHERE s = s_suppkey), '') AS brands FROM supplier WHERE s_suppkey % 4 <> 0""",
    "override_resolution": f"""
WITH c AS (SELECT date_iso, {_N("place")} p, arg_min(crop, (batch_no, assertion_id)) told FROM source_assertions WHERE crop <> '' GROUP BY 1, 2), f AS (SELECT DISTINCT formation_id, date_iso, {_N("place")} p, nullif(trim(crop), '') crop FROM formations)
SELECT formation_id, coalesce(crop, told) AS crop, CASE WHEN crop IS NOT NULL THEN 'own' WHEN told IS NOT NULL THEN 'told' ELSE 'none' END AS origin FROM f LEFT JOIN c USING (date_iso, p)""",
    "link_union_last_wins": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS orderkey, CASE WHEN o_custkey % 3 = 0 THEN '0-CHANGED' ELSE max(o_orderpriority) END AS priority FROM orders GROUP BY 1, 2",
    "managed_replace": "SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part",
    "fk_explode_index": "WITH r AS (SELECT DISTINCT url, trim(unnest(string_split(roles, ';'))) AS role FROM iccra_report_links_full) SELECT role, count(*) AS urls, min(url) AS first_url FROM r WHERE role <> '' GROUP BY role",
    "image_count_union": """
WITH p AS (SELECT matched_formation_id AS id, commons_image_id AS i FROM commons_crop_circle_assertions WHERE matched_formation_id <> ''),
r AS (SELECT DISTINCT nullif(trim(lower(alias_formation_id)), '') AS id, nullif(trim(lower(canonical_formation_id)), '') AS t FROM formation_alias_reviews WHERE lower(trim(review_status)) = 'accepted'),
u AS (SELECT id, i FROM p UNION ALL SELECT t, i FROM p JOIN r USING (id) WHERE id <> t)
SELECT id AS formation_id, count(DISTINCT i) AS pictures FROM u GROUP BY id""",
    "fill_missing_slots": """
WITH p AS (SELECT source_page, unnest(generate_series(1, max(source_slot)::bigint))::int AS slot FROM source_assertions WHERE source_slot > 0 AND source_page IS NOT NULL GROUP BY source_page)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM source_assertions s WHERE s.source_page = p.source_page AND s.source_slot = p.slot)""",
    "interval_overlap": """
WITH s AS (SELECT source_name, crawl_run_id, min(retrieved_at)::date lo, max(retrieved_at)::date hi FROM source_assertions WHERE crawl_run_id IS NOT NULL AND retrieved_at IS NOT NULL GROUP BY 1, 2)
SELECT a.source_name, a.crawl_run_id, b.crawl_run_id AS other_run FROM s a JOIN s b ON a.source_name = b.source_name AND a.crawl_run_id < b.crawl_run_id AND a.lo <= b.hi AND b.lo <= a.hi""",
    "work_queue_rank": """
WITH f AS (SELECT DISTINCT formation_id, country_code, coalesce(source_count, 0) * 10 + CASE WHEN latitude IS NOT NULL THEN 5 ELSE 0 END AS score FROM formations)
SELECT *, row_number() OVER (ORDER BY score DESC, formation_id) AS rank FROM f""",
    "marginal_counts": " UNION ALL ".join(f"SELECT '{c}' AS field, cast({c} AS varchar) AS value, count(*) AS n FROM formations GROUP BY {c}" for c in ("country_code", "geocode_method", "orientation_status", "classification")),
    "grouping_sets": "SELECT c AS country_code, m AS method, count(*) AS n, grouping(c, m) AS level FROM (SELECT coalesce(country_code, '-') c, coalesce(geocode_method, '-') m FROM formations) GROUP BY CUBE (c, m)",
    "summary_counts": """SELECT count(formation_id) AS rows_with_id, count(DISTINCT formation_id) AS formations, count(*) FILTER (WHERE country_code = 'US') AS in_us, count(latitude) AS placed, min(date_iso) AS first_date, max(date_iso) AS last_date, sum(source_count) AS sources FROM formations""",
    "top_n_counts": "SELECT country_code, count(*) AS n FROM formations WHERE country_code <> '' GROUP BY 1 ORDER BY n DESC, country_code LIMIT 15",
    "conditional_distinct": """
WITH p AS (SELECT regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS kind, url, bool_or(coalesce(http_status LIKE '2%', false)) ever, bool_or(NOT coalesce(http_status LIKE '2%', false)) bad FROM iccra_report_links_full GROUP BY 1, 2)
SELECT kind, count(*) AS urls, count(*) FILTER (WHERE ever) AS fetched, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE NOT ever) AS never FROM p GROUP BY kind""",
    "source_yield": f"""
WITH r AS (SELECT source_name, batch_no, assertion_id, concat_ws('|', coalesce(date_iso, ''), {_N("coalesce(place, '')")}, {_N("coalesce(region, '')")}, coalesce(country_code, '')) AS key FROM source_assertions), f AS (SELECT key, min(batch_no) fb FROM r GROUP BY key),
p AS (SELECT source_name, count(DISTINCT assertion_id) a, count(DISTINCT key) k, count(DISTINCT CASE WHEN fb < batch_no THEN key END) o FROM r JOIN f USING (key) GROUP BY 1)
SELECT source_name, coalesce(a, 0) AS assertions, coalesce(k, 0) AS keys, coalesce(o, 0) AS overlapping FROM (SELECT DISTINCT name AS source_name FROM source_catalog) LEFT JOIN p USING (source_name)""",
    "set_overlap": f"""
WITH p AS (SELECT concat_ws('|', coalesce(date_iso, ''), {_N("coalesce(place, '')")}) AS key, bool_or(batch_no = 0) o, bool_or(batch_no > 0) n FROM source_assertions GROUP BY 1)
SELECT count(*) FILTER (WHERE o) AS history, count(*) FILTER (WHERE n) AS later, count(*) FILTER (WHERE o AND n) AS both, count(*) FILTER (WHERE o <> n) AS one_only FROM p""",
    "reconciliation": """
WITH c AS (SELECT crawl_run_id, count(DISTINCT assertion_id) AS counted FROM source_assertions WHERE crawl_run_id IS NOT NULL GROUP BY 1)
SELECT crawl_run_id, r."yield".expansion_assertions AS stated, counted, coalesce(counted, 0) - r."yield".expansion_assertions AS difference FROM source_expansion_reconciliation r FULL JOIN c USING (crawl_run_id)""",
    "confusion_metrics": """
WITH p AS (SELECT DISTINCT commons_assertion_id, matched_formation_id AS formation_id, date_iso AS pd, lower(trim(match_status)) AS s FROM commons_crop_circle_assertions), f AS (SELECT DISTINCT formation_id, date_iso, country_code FROM formations),
j AS (SELECT country_code, coalesce(pd = date_iso, false) t, coalesce(s = 'exact_place_and_date', false) x FROM p JOIN f USING (formation_id)),
c AS (SELECT country_code, count(*) FILTER (WHERE t AND x) tp, count(*) FILTER (WHERE NOT t AND x) fp, count(*) FILTER (WHERE t AND NOT x) fn, count(*) FILTER (WHERE NOT t AND NOT x) tn FROM j GROUP BY 1)
SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0)::double, 4) AS accuracy, round(tp / nullif(tp + fp, 0)::double, 4) AS precision, round(tp / nullif(tp + fn, 0)::double, 4) AS recall, round(tn / nullif(tn + fp, 0)::double, 4) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 4) AS f1 FROM c""",
    "error_summary": """SELECT strftime(l_shipdate, '%Y-%m') AS month, round(quantile_cont(l_discount * 100, 0.5), 4) AS median_error, round(sqrt(avg(l_discount * 100 * (l_discount * 100))), 4) AS rmse, round(max(l_discount * 100), 4) AS max_error, round(quantile_cont(l_discount * 100, 0.95), 4) AS p95_error FROM lineitem GROUP BY 1""",
    "axis_mean": """
WITH r AS (SELECT l_suppkey, (l_partkey * 37 % 60 + 20)::double a, l_quantity w FROM lineitem), s AS (SELECT l_suppkey, degrees(atan2(sum(w * sin(radians(2 * a))), sum(w * cos(radians(2 * a))))) / 2 m, sum(w) w, count(*) n FROM r GROUP BY 1),
m AS (SELECT l_suppkey, ((m % 180) + 180) % 180 m, w, n FROM s)
SELECT l_suppkey, round(m, 4) AS axis_mean, round(sqrt(sum(r.w * power(abs((((a - m + 90) % 180) + 180) % 180 - 90), 2)) / any_value(m.w)), 4) AS axis_deviation, any_value(n) AS n FROM r JOIN m USING (l_suppkey) GROUP BY l_suppkey, m""",
    "reference_merge": """
WITH r AS (SELECT DISTINCT discovered_from, trim(unnest(string_split(roles, ';'))) AS role FROM iccra_report_links_full), g AS (SELECT discovered_from, string_agg(role, '; ' ORDER BY role) AS roles FROM r WHERE role <> '' GROUP BY 1)
SELECT discovered_from, max(length(coalesce(anchor_text, ''))) AS longest_anchor, max(bytes) AS largest, coalesce(any_value(g.roles), '') AS roles FROM iccra_report_links_full LEFT JOIN g USING (discovered_from) WHERE discovered_from IS NOT NULL GROUP BY 1""",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events",
    "latest_state": """WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events)
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (WHERE b <> event_type) AS changes FROM s GROUP BY user_id""",
    "fk_audit": " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) AS checked, count(*) FILTER (WHERE {fk} IS NULL) AS missing, count(*) FILTER (WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} x WHERE x.{pk} = c.{fk})) AS orphans FROM {c} c"
        for n, c, fk, p, pk in (("picture_formation", "commons_crop_circle_assertions", "matched_formation_id", "formations", "formation_id"), ("assertion_source", "source_assertions", "source_name", "source_catalog", "name"), ("alias_canonical", "formation_alias_reviews", "canonical_formation_id", "formations", "formation_id"), ("order_customer", "orders", "o_custkey", "customer", "c_custkey"))
    ),
    "uniqueness_audit": " UNION ALL ".join(
        f"SELECT '{n}' AS rule, sum(c) AS rows, count(*) AS keys, count(*) FILTER (WHERE c > 1) AS repeated FROM (SELECT {k}, count(*) c FROM {n} GROUP BY 1)"
        for n, k in (("source_assertions", "assertion_id"), ("formations", "formation_id"), ("commons_crop_circle_assertions", "commons_assertion_id"), ("legacy_kml_candidate_queue", "legacy_candidate_id"), ("iccra_report_links_full", "url"))
    ),
    "coverage_audit": """SELECT CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'no_position' WHEN abs(latitude) > 90 OR abs(longitude) > 180 THEN 'impossible' WHEN latitude = 0 AND longitude = 0 THEN 'placeholder' ELSE 'usable' END AS outcome, count(*) AS rows, count(DISTINCT legacy_candidate_id) AS candidates FROM legacy_kml_candidate_queue GROUP BY 1""",
    "alias_guard": """
WITH r AS (SELECT DISTINCT nullif(trim(lower(alias_formation_id)), '') a, nullif(trim(lower(canonical_formation_id)), '') c FROM formation_alias_reviews WHERE lower(trim(review_status)) = 'accepted'),
s AS (SELECT a AS id, 1 AS x, 0 AS y FROM r WHERE a <> c UNION ALL SELECT c, 0, 1 FROM r WHERE a <> c), p AS (SELECT id, sum(x) AS named, sum(y) AS canonical_for FROM s GROUP BY id)
SELECT * FROM p WHERE named > 1 OR (named > 0 AND canonical_for > 0)""",
    "geocode_variants": f"""
WITH r AS (SELECT assertion_id, coalesce(country_code, '') cc, {_N("regexp_replace(place, '[/;].*$', '')")} w FROM {_A1}), s AS (SELECT *, string_split(w, ' ') l FROM r WHERE w <> ''),
v AS (SELECT assertion_id, cc, 0 AS variant, w AS name FROM s UNION ALL SELECT assertion_id, cc, 1, array_to_string(l[1:len(l) - 1], ' ') FROM s UNION ALL SELECT assertion_id, cc, 2, l[1] FROM s),
k AS (SELECT DISTINCT formation_id, coalesce(country_code, '') cc, {_N("place")} name, coalesce(source_count, 0) wt FROM formations WHERE latitude IS NOT NULL AND NOT isnan(latitude)),
b AS (SELECT cc, name, arg_min(formation_id, (-wt, formation_id)) f FROM k GROUP BY 1, 2)
SELECT assertion_id, min(variant) AS variant, arg_min(f, variant) AS formation_id FROM v JOIN b USING (cc, name) WHERE name <> '' GROUP BY assertion_id""",
    "certified_scan": "SELECT source_id, name FROM source_catalog",
    "lenient_flags": """
WITH r AS (SELECT DISTINCT nullif(trim(lower(alias_formation_id)), '') a, nullif(trim(lower(canonical_formation_id)), '') c, coalesce(lower(trim(review_status)) = 'accepted', false) ok FROM formation_alias_reviews)
SELECT ok, count(*) AS pairs, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r b WHERE b.a = r.c AND b.c = r.a)) AS reversed_pairs, count(*) FILTER (WHERE a = c) AS self_pairs FROM r GROUP BY ok""",
}
