import datetime as dt
import random

from meridian.llm.components import components
from meridian.llm.survivors import chosen, discover, survivors


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(170)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]  # a chain
    pairs += [("hub", f"z{i}") for i in range(60)] + [("Hub ", " z1"), ("z1", "hub")]  # a star, and other spellings
    dirty = [(None, "a"), ("a", None), ("", "q"), ("  ", "q"), ("self", "self"), (" SELF", "self")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs + dirty], "l string, r string, id string, a int")
    got = {r.id: r.group_id for r in components(df, "l", "r").collect()}
    want = brute([(a.strip().lower(), b.strip().lower()) for a, b in pairs if a.strip().lower() != b.strip().lower()])
    assert got == want
    assert components(df.limit(0), "l", "r").count() == 0


FIELDS = ["place", "lat"]


def record(g, k, status, place, lat, day):
    return (g, k, status, place, lat, day and dt.datetime(2020, 1, day), "extra", "v")


def test_survivor_order_and_filling(spark):
    rows = [
        record("f1", "b", " Good", "P", None, 1), record("f1", "a", "good", "P", None, 1), record("f1", "c", "best", None, None, 1), record("f1", "d", "other", "", 2.5, 9), record("f1", "d", "other", "", 2.5, 9),
        record("f2", "a", None, "x", 1.0, 2), record("f2", "b", None, "y", 1.0, 3), record("f2", "c", None, "y", 1.0, None),
        record("alone", "z", "best", "p", 1.0, 1), record("alone", "z", "best", "p", 1.0, 1), record("", "q", "best", "p", 1.0, 1), record(None, "q2", "best", "p", 1.0, 1), record("f1", None, "best", "p", 1.0, 1),
    ]
    df = spark.createDataFrame(rows, "fid string, key string, status string, place string, lat double, at timestamp, g string, source string")
    got = {r.fid: r for r in survivors(df, "fid", "key", "status", ["best", "good"], FIELDS, "at", "source").collect()}
    assert set(got) == {"f1", "f2"}
    assert (got["f1"].key, got["f1"].place, got["f1"].lat, got["f1"].filled_fields) == ("c", "P", 2.5, ["lat", "place"])
    assert (got["f2"].key, got["f2"].place) == ("b", "y")
    assert survivors(df.limit(0), "fid", "key", "status", ["best"], FIELDS, "at", "source").count() == 0
    assert {(r.fid, r.key) for r in chosen(df, "fid", "key", "status", ["best", "good"], FIELDS, "at").collect()} == {("f1", "c"), ("f2", "b")}


def test_truth_discovery_trusts_who_is_right_elsewhere(spark):
    claims = [(f"i{k}", "f", f"t{k}", s) for k in range(20) for s in ("good", "fair")] + [(f"i{k}", "f", f"w{k}", "bad") for k in range(20)]
    claims += [("last", "f", "right", "good"), ("last", "f", "wrong", "bad"), ("tie", "f", "b", "good"), ("tie", "f", "a", "good"), (None, "f", "x", "good"), ("none", "f", None, "good")]
    got = {r.item: r.value for r in discover(spark.createDataFrame(claims, "item string, field string, value string, source string")).collect()}
    assert got["last"] == "right" and got["i3"] == "t3" and got["tie"] == "a" and "none" not in got
