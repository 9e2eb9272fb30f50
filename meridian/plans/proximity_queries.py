"""Queries of the proximity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.geo import DUPLICATE_RADIUS_M
from meridian.operators.proximity import pairs_within
from meridian.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of placemarks within 200 m."""
    queue = table(spark, sf_dir, "legacy_kml_candidate_queue")
    pairs = pairs_within(queue, "legacy_candidate_id", "latitude", "longitude", 200.0, DUPLICATE_RADIUS_M)
    return pairs.select(F.col("key_a").alias("legacy_candidate_id_a"), F.col("key_b").alias("legacy_candidate_id_b"))


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
WITH k AS (
  SELECT DISTINCT legacy_candidate_id AS id, latitude AS y, longitude AS x FROM legacy_kml_candidate_queue
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180
    AND NOT (latitude = 0 AND longitude = 0) AND legacy_candidate_id IS NOT NULL)
SELECT DISTINCT a.id AS legacy_candidate_id_a, b.id AS legacy_candidate_id_b
FROM k a JOIN k b ON a.id < b.id AND b.y BETWEEN a.y - 0.01 AND a.y + 0.01
WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(b.y - a.y) / 2), 2)
  + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2)))) <= 200.0""",
}
