import pytest
from pyspark.sql import types as T

from meridian.sources import files
from meridian.streaming.events import once, sessions

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])


def test_csv_with_mark_quotes_and_absence(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,n,x\n"a, ""b""",1,2.5\nc,,no\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()] == [('a, "b"', 1, 2.5), ("c", None, None)]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), SCHEMA).count() == 0
    assert files.read_json(spark, str(tmp_path / "none.json"), SCHEMA).count() == 0


def test_csv_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None)], "id string, tags array<string>, n int")
    files.write_csv(df, str(tmp_path / "o"))
    back = files.read_csv(spark, str(tmp_path / "o"), T.StructType([T.StructField(c, T.StringType()) for c in ("id", "tags", "n")]))
    assert [tuple(r) for r in back.collect()] == [("a", "x; y", None)]


def test_kml_in_archives(spark, tmp_path):
    kml = files.kml_text([{"name": "A & B", "longitude": -1.5, "latitude": 51.25}], "t").encode()
    inner = files.zip_bytes({"doc.kml": kml})
    assert inner == files.zip_bytes({"doc.kml": kml})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.kmz").write_bytes(files.zip_bytes({"x/inner.kmz": inner, "../evil.kml": kml, "bad.kml": b"<kml", "big.kml": b"\0" * 5_000_000}))
    (tmp_path / "in" / "b.kml").write_bytes(b"<!DOCTYPE x><kml/>")
    rows = files.read_kml(spark, str(tmp_path / "in")).collect()
    assert sorted(r.status for r in rows) == ["broken: ParseError", "broken: ValueError", "ok", "too_large", "unsafe_path"]
    good = next(r for r in rows if r.status == "ok")
    assert (good.name, good.longitude, good.latitude, good.folder) == ("A & B", -1.5, 51.25, "t")


def test_geojson_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, ""), ("b", None, 2.0, "p")], "id string, lat double, lon double, place string")
    rows = files.geojson(df, "id", "lat", "lon", ["place"]).collect()
    assert len(rows) == 1 and '"coordinates":[2.0,1.0]' in rows[0].feature and "place" not in rows[0].feature


def test_canonical_json():
    assert files.canonical_json({"b": 1, "a": ["é"]}) == '{"a":["é"],"b":1}'


@pytest.mark.parametrize("run", ["sessions", "once"])
def test_stream_agrees_with_batch(spark, data, tmp_path, run):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    make = (lambda df: sessions(df, "user_id", "ts", late="1 hour")) if run == "sessions" else (lambda df: once(df, ["user_id", "event_type"], "ts", "90 days").select("user_id", "event_type"))
    query = make(stream).writeStream.format("memory").queryName(f"out_{run}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got, want = {tuple(r) for r in spark.table(f"out_{run}").collect()}, {tuple(r) for r in make(events).collect()}
    assert got and (got <= want if run == "sessions" else got == want)


def test_pages(spark):
    from meridian.sources.html import parse_pages

    html = "<html><title>A &amp; B</title><script>var x='<a href=no>'</script><body><ul><li><a href='../x.html#f'>One <b>two</b></a><li><img src=p.jpg alt='a  b'><p>para"
    df = spark.createDataFrame([("https://h.example/d/i.html", html), ("u", None), ("e", "")], "url string, html string")
    got = {r.url: r for r in parse_pages(df, "url", "html").collect()}
    page = got["https://h.example/d/i.html"]
    assert page.title == "A & B" and [(a.url, a.text) for a in page.links] == [("https://h.example/x.html", "One two")]
    assert [(i.url, i.alt) for i in page.images] == [("https://h.example/d/p.jpg", "a b")] and page.text == "One two\npara"
    assert got["u"].title is None and got["e"].links == []


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    files.upsert_csv(spark, path, rows((1, "a"), (2, "b")), "k")
    files.upsert_csv(spark, path, rows((2, "c"), (3, "d")), "k", replace=True)
    read = lambda: sorted(tuple(r) for r in spark.read.option("header", True).schema("k int, v string").csv(path).collect())
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="already there: 3"):
        files.upsert_csv(spark, path, rows((3, "e")), "k")
    assert read() == [(1, "a"), (2, "c"), (3, "d")]


def test_artifacts_are_stored_once(spark, tmp_path):
    first, again = files.save_artifact(spark, str(tmp_path), '{"a":1}'), files.save_artifact(spark, str(tmp_path), '{"a":1}')
    assert first == (again[0], False) and again[1] and files.save_artifact(spark, str(tmp_path), "other")[0] != first[0]


def test_strict_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert files.strict(df, ["a"], ["b"]) is df
    with pytest.raises(ValueError, match="missing: c; unknown: b"):
        files.strict(df, ["a", "c"])
