import math
import random

from pyspark.sql import functions as F

from meridian.functions import dates, text
from meridian.operators import analytics
from meridian.sources import files


def axis_gap(a, b):
    return abs((a - b + 90) % 180 - 90)


def mean_axis(members):
    s = sum(w * math.sin(2 * math.radians(a)) for w, a in members)
    c = sum(w * math.cos(2 * math.radians(a)) for w, a in members)
    return math.degrees(math.atan2(s, c)) / 2 % 180


def test_segment_clusters_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("gh"), round(rng.uniform(-10, 200), 2), float(rng.randrange(1, 9))) for _ in range(300)]
    got = analytics.segment_clusters(spark.createDataFrame(rows, "g string, a double, w double"), ["g"], "a", "w").orderBy("g", "cluster").collect()
    want = []
    for g in "gh":
        own = [(w, a % 180) for k, a, w in rows if k == g]
        seeds = []
        for _, a in own:
            m = [(w, x) for w, x in own if axis_gap(a, x) <= 4 + 1e-9]
            axis = mean_axis(m)
            weight = sum(w for w, _ in m)
            seeds.append((-round(weight, 9), round(axis, 9) % 180, len(m), math.sqrt(sum(w * axis_gap(x, axis) ** 2 for w, x in m) / weight), max(w for w, _ in m)))
        kept = []
        for s in sorted(seeds):
            if all(axis_gap(s[1], k[1]) > 10 for k in kept):
                kept.append(s)
        want += [(g, i + 1, -s[0], s[1], s[2], s[3], s[4]) for i, s in enumerate(kept)]
    assert len(got) == len(want)
    for r, (g, i, support, axis, n, deviation, longest) in zip(got, want):
        assert (r.g, r.cluster, r.support, r.members, r.longest) == (g, i, support, n, longest)
        assert abs(r.axis - axis) < 1e-6 and abs(r.deviation - deviation) < 1e-6
    assert analytics.segment_clusters(spark.createDataFrame([], "g string, a double, w double"), ["g"], "a", "w").count() == 0


def test_ranks_run_through_the_whole_table(spark):
    rows = [(i, i * 7 % 10) for i in range(500)]
    got = analytics.ranked(spark.createDataFrame(rows, "k int, s int"), F.desc("s"), F.col("k")).collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["rank"])] == [k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert analytics.ranked(spark.createDataFrame([], "k int, s int"), F.desc("s"), F.col("k")).count() == 0


def test_dates_that_cannot_be_ordered(spark):
    pairs = [("2003-07-04", "2003-08-08", "later"), ("1994-06-14", "1994-06-08", "earlier"), ("2003-07", "2003-07-24", "overlap_or_indeterminate"), ("2003", None, "overlap_or_indeterminate"), ("x", "2003", "overlap_or_indeterminate"), ("2003-02-31", "1999", "overlap_or_indeterminate")]
    rows = spark.createDataFrame(pairs, "a string, b string, want string").select("want", dates.relation(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_page_keys(spark):
    same = [("http://www.Pages.example/A%20B/c.htm?X=1#top", "https://pages.example/a b/C.HTM?x=1"), ("http://p.example/caf%C3%A9", "http://p.example/caf%E9"), ("http://p.example/a b", "http://p.example/a b"), ("http://p.example/ﬁeld", "http://p.example/field"), ("http://p.example/x?", "http://p.example/x")]
    other = [("http://p.example/x?a=1", "http://p.example/x?a=2"), ("http://p.example/x", "http://p.example/x/"), ("http://p.example/x", "http://q.example/x")]
    for pairs, want in ((same, True), (other, False)):
        rows = spark.createDataFrame(pairs, "a string, b string").select((text.url_key(F.col("a")) == text.url_key(F.col("b"))).alias("v")).collect()
        assert all(r.v is want for r in rows)
    assert spark.createDataFrame([("mailto:x",), (None,)], "u string").where(text.url_key(F.col("u")).isNotNull()).count() == 0


def test_archives_share_one_limit(monkeypatch):
    kml = b"<kml></kml>"
    inner = files.zip_bytes({"a.kml": kml, "b.kml": kml})
    deep = files.zip_bytes({"in.kmz": files.zip_bytes({"in.zip": inner})})
    assert [r for _, _, r in files.members(deep, "x.zip")] == ["ok", "ok"]
    assert [r for _, _, r in files.members(files.zip_bytes({"more.zip": deep}), "x.zip")] == ["too_deep"]
    monkeypatch.setattr(files, "MAX_TOTAL_BYTES", 2 * len(inner) + len(kml) + 3)
    both = files.zip_bytes({"1.kmz": inner, "2.kmz": inner})
    assert sorted(r for _, _, r in files.members(both, "x.zip")) == ["ok", "ok", "total_too_large"]
    wide = "<?xml version='1.0' encoding='utf-16'?><!DOCTYPE k [<!ENTITY e 'x'>]><kml/>"
    for encoding in ("utf-16-le", "utf-16-be", "utf-32-le"):
        try:
            list(files.placemarks(wide.encode(encoding)))
        except ValueError as refused:
            assert "entities" in str(refused)
        else:
            raise AssertionError(encoding)
