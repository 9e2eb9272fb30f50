import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from meridian.llm import confusables, mojibake
from meridian.llm import history, linkage, queries
from meridian.llm.history import HistoryIndex, retold, signatures
from meridian.llm.linkage import SLOTS, Space, _keys, link, with_tokens
from meridian.llm.places import core, fold, number, one_slip, same_area

STORY = "assertion_id string, batch_no int, date_iso string, place string, region string, country_code string, sig string, token long"


def told(k, batch, date, place, region="Wendshire", cc="GB"):
    return (k, batch, date, place, region, cc, "x", 1)


def test_retold_events(spark):
    rows = [
        told("a1", 0, "2001-07-05", "Ludgumond Down"), told("a2", 0, "2001-07-05", "Ludgumond Hill"), told("a3", 0, "2001-07-05", "Étang de Pelfoféll (1)", "Île-aux-Blés", "FR"), told("a4", 0, "2001-07-10", "Kelbridge Bridge"),
        told("b1", 1, "2001-07-07", "nr LUDGUMOND-DOWN, nr Barfold"), told("b1", 1, "2001-07-07", "nr LUDGUMOND-DOWN, nr Barfold"), told("b2", 1, "2001-07", "Ludgumnod Down", "Wend."), told("b3", 2, "2001-07-05", "Etang de Pelfofell (2)", None, "FR"),
        told("b4", 2, "2001-07-05", "Etang de Peelfofell (1) / Sib road", "", None), told("b5", 3, "2001-08-05", "Ludgumond Down"), told("b6", 3, "2001-07-08", "Ludgumond Down"), told("b7", 3, "2001-07-05", "Ludgumond Down", "Sable County", "US"),
        told("b8", 3, "2001-07-08", "Ludgumond Down"), told("b9", 4, "2001-07-09", "Ludgumond Down"), told("n1", 4, None, "Ludgumond Down"), told("n2", 4, "2001-07-05", None), told("n3", None, "2001-07-05", "Ludgumond Down"), told(None, 4, "2001-07-05", "Ludgumond Down"), told("n4", 4, "2001-07-05", "word " * 5000),
    ]
    got = {r.id: r.earlier for r in retold(spark.createDataFrame(rows, STORY)).collect()}
    assert got == {"b1": "a1", "b2": "a1", "b4": "a3", "b6": "b1", "b8": "b1", "b9": "b1"}


def test_retold_against_all_pairs(spark):
    rng = random.Random(8)
    names = ["Ashbold Down", "Ashbald Down", "Kelham Ridge", "Kelham Bridge", "Torsby (1)", "Torsby (2)", "Mornford Wood"]
    rows = []
    for i in range(250):
        name = rng.choice(names)
        if rng.random() < 0.3:
            at = rng.randrange(1, len(name) - 1)
            name = name[:at] + name[at + 1 :]
        rows.append(told(f"k{i:03d}", rng.randrange(4), rng.choice(["2001-07-%02d" % rng.randrange(1, 9), "2001-07"]), name, rng.choice(["Wendshire", None, "Wend."])))
    df = spark.createDataFrame(rows, STORY)
    others = spark.createDataFrame([told(f"z{i}{kind}", 0, "1990-05-01", f"{stem}ham {kind}") for i, stem in enumerate(["Tor", "Wim", "Pel", "Sib", "Lud", "Gum", "Yar", "Quen"]) for kind in ("Down", "Ridge", "Bridge", "Wood")], STORY)
    got = {r.id: r.earlier for r in retold(df.unionByName(others)).collect()}
    place = fold(F.col("place"))
    flat = df.select("assertion_id", "batch_no", "date_iso", "region", core(place).alias("name"), number(place).alias("num")).toPandas().to_dict("records")
    kinds = {"down", "ridge", "bridge", "wood"}
    slips = {(a, b): ok for a, b, ok in spark.createDataFrame([(a["name"],) for a in flat], "a string").distinct().crossJoin(spark.createDataFrame([(a["name"],) for a in flat], "b string").distinct()).select("a", "b", one_slip(F.col("a"), F.col("b"))).collect()}

    def same(a, b):
        days = [int(x["date_iso"][8:]) if len(x["date_iso"]) == 10 else None for x in (a, b)]
        x, y = set(a["name"].split()) - set(b["name"].split()), set(b["name"].split()) - set(a["name"].split())
        return a["num"] == b["num"] and (None in days or abs(days[0] - days[1]) <= 2) and slips[a["name"], b["name"]] and not (x & kinds and y & kinds)

    want = {}
    for b in flat:
        hits = [(a["batch_no"], a["assertion_id"]) for a in flat if a["batch_no"] < b["batch_no"] and same(a, b)]
        if hits:
            want[b["assertion_id"]] = min(hits)[1]
    assert got == want


def test_short_names_are_met_too(spark):
    pairs = [("Ely", "Eby"), ("Bath", "Btah"), ("Bath", "Bah"), ("Io", "Yo"), ("Ab", "Ba"), ("A", "B"), ("Usk", "Uskk"), ("aaaa", "aaab"), ("Xaaaaaaaa", "aaaaaaaa"), ("ab" * 60, "ab" * 60 + "a"), ("Otley", "Olney")]
    rows = [told(f"{side}{i:02d}", side == "b", f"20{i:02d}-07-05", name) for i, pair in enumerate(pairs) for side, name in zip("ab", pair)]
    rows = [(k, int(b), *rest) for k, b, *rest in rows]
    got = {r.id: r.earlier for r in retold(spark.createDataFrame(rows, STORY)).collect()}
    assert got == {f"b{i:02d}": f"a{i:02d}" for i in range(len(pairs) - 1)}


def test_an_index_is_opened_again_by_its_path(spark, monkeypatch):
    path = history.scratch(spark, "kept")
    first = spark.createDataFrame([told("a1", 0, "2001-07-05", "Ludgumond Down"), told("a2", 1, "2001-08-05", "Kelbridge Hill")], STORY)
    assert retold(first, path).count() == 0
    monkeypatch.setattr(HistoryIndex, "_keep", lambda self: (_ for _ in ()).throw(RuntimeError("interrupted")))
    second = spark.createDataFrame([told("b1", 2, "2001-07-06", "Ludgumnod Down"), told("b2", 2, "2001-08-05", "Kelbridge Hill")], STORY)
    with pytest.raises(RuntimeError):
        retold(second, path)
    monkeypatch.undo()
    again = spark.newSession()
    got = {r.id: (r.earlier, r.earlier_batch) for r in retold(again.createDataFrame(second.collect(), STORY), path).collect()}
    assert got == {"b1": ("a1", 0), "b2": ("a2", 1)}
    index = HistoryIndex(again, path)
    assert index.batches == [0, 1, 2]
    with pytest.raises(ValueError):
        index.accept(signatures(second), 2)
    monkeypatch.setattr(history, "BROADCAST_BYTES", 0)
    third = again.createDataFrame([told("c1", 3, "2001-07-05", "Ludgumond Down")], STORY)
    assert [(r.id, r.earlier) for r in retold(third, path).collect()] == [("c1", "a1")]


def test_retold_of_nothing(spark):
    assert retold(spark.createDataFrame([], STORY)).count() == 0
    assert retold(spark.createDataFrame([told("a", 0, "2001-07-05", "x")], STORY)).count() == 0


@pytest.mark.parametrize("a,b,same", [("ashbold down", "ashbold down", True), ("ashbold down", "ashbld down", True), ("ashbold down", "ashblod down", True), ("ashbold down", "ashbzld down", True), ("ashbold down", "ashxxld down", False), ("abcd", "badc", False), ("", "", True)])
def test_slips(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(one_slip(F.col("a"), F.col("b")).alias("v")).first().v is same


def test_areas(spark):
    rows = [("", False, "x", False, True), ("wend", True, "wendshire", False, True), ("wend", False, "wendshire", False, False), ("sable", False, "wend", True, False)]
    df = spark.createDataFrame(rows, "a string, s boolean, b string, t boolean, want boolean")
    assert all(r.v == r.want for r in df.select("want", same_area(F.col("a"), F.col("s"), F.col("b"), F.col("t")).alias("v")).collect())


CLEAN = ["Größe und Höhe der Ähren", "Découverte à Fenkald – « relevé » 182", "SÃO MARTINHO", "Źdźbła zgięte – próbka 439", "Отчёт № 32: круги на поле", "Αναφορά 700: κύκλοι στο σιτάρι", "麦畑の円形模様 2015年", "½ mile from there", "Příloha 104 – měření stébel", "Raport 472: părți din lanul de grâu"]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1250"), ("utf-8", "cp1251")]


def garbled():
    out = []
    for t in CLEAN:
        for write, read in CHAINS:
            try:
                bad = t.encode(write).decode(read)
            except UnicodeDecodeError:
                continue
            out.append((bad, t))
    out.append((CLEAN[0].encode().decode("latin-1").encode().decode("latin-1"), CLEAN[0]))
    return out


def test_garbled_texts_are_found_and_restored(spark):
    pairs = garbled()
    rows = [(f"c{i}-{j}", t, "t") for i, t in enumerate(CLEAN) for j in range(6)] + [(f"g{i}", bad, "t") for i, (bad, _) in enumerate(pairs)]
    rows += [("lost", "M�tningar", ""), ("null", None, ""), ("empty", "", ""), ("ascii", "plain", ""), ("g0", pairs[0][0], "")]
    df = spark.createDataFrame(rows, "key string, text string, t string")
    got = mojibake.repair(df, "key", "text").collect()
    found = {r.key: r.restored for r in got}
    assert not [k for k in found if k.startswith("c")] and "lost" in found and not {"null", "empty", "ascii"} & set(found)
    restored = sum(found.get(f"g{i}") == good for i, (_, good) in enumerate(pairs))
    assert sum(f"g{i}" in found for i in range(len(pairs))) >= 0.97 * len(pairs) and restored >= 0.9 * len(pairs)
    assert sum(r.key == "g0" for r in got) == 2
    assert mojibake.repair(df.limit(0), "key", "text").count() == 0


def many_anchors():
    words = ["Größe", "Höhe", "Halme", "Zählung", "Straße", "survey", "report", "relevé"]
    return [f"{words[i % 8]} {words[i // 8 % 7]} {'x' * (i % 5)} {i}" for i in range(24_000)] + ["Zelpamo±d 7", "Ã¼ber Ã¤hren", "麦畑の円形模様", None, ""]


def sign_bytes(texts):
    clean = [t for t in set(texts) if t and (t.isascii() or mojibake.fitting(t)) and not any(mojibake.from_utf8(t, e) != t for e in ("cp1252", "latin-1"))]
    inside = sum(a.isalpha() and b.isalpha() for t in clean for a, b in zip(t, t[1:]))
    return np.log2((inside + 2) / (sum(map(mojibake.odd_signs, clean)) + 1)) / 8


def test_all_texts_train_the_description(spark):
    texts = many_anchors()
    df = spark.createDataFrame([(t,) for t in texts if t], "text string").distinct()
    dictionaries, sign = mojibake.train(df)
    assert abs(sign - sign_bytes(texts)) < 1e-9 and {"en", "de", "fr", "ja"} <= set(dictionaries)
    assert (dictionaries, sign) == mojibake.train(df.repartition(7))
    assert mojibake.train(df.limit(0)) == ({}, 1 / 8)


def test_forms_are_judged_by_all_anchors(spark, data, tmp_path, monkeypatch):
    texts = many_anchors() + ["Dоrford Größe", "Ｈöhe"]
    anchors = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, anchor_text string")
    anchors.write.parquet(f"{tmp_path}/iccra_report_links_full.parquet")
    spark.read.parquet(f"{data}/commons_crop_circle_assertions.parquet").write.parquet(f"{tmp_path}/commons_crop_circle_assertions.parquet")
    signs, train = [], mojibake.train
    monkeypatch.setattr(mojibake, "train", lambda df: signs.append(train(df)) or signs[-1])
    got = {r.record_key for r in queries.p4_forms(spark, str(tmp_path)).where("table_name = 'iccra_report_links_full'").collect()}
    assert got == {f"u{len(texts) - 2}", f"u{len(texts) - 1}"}
    assert [abs(s - sign_bytes(texts)) < 1e-9 for _, s in signs] == [True]


def test_dictionaries_are_trained_on_every_clean_text(spark):
    texts = [t for t in many_anchors() if t]
    dictionaries, _ = mojibake.train(spark.createDataFrame([(t,) for t in texts], "text string").distinct())
    german = sorted(t.encode() for t in set(texts) if not t.isascii() and "de" in mojibake.fitting(t) and mojibake.from_utf8(t, "cp1252") == t)
    english = sorted(t.encode() for t in set(texts) if t.isascii())
    for lang, samples in (("de", german), ("en", english)):
        whole = zstandard.train_dictionary(mojibake.DICTIONARY_BYTES, samples, level=9, split_point=1.0)
        assert len(samples) > 3000 and dictionaries[lang] == whole.as_bytes()


def test_look_alikes_that_a_reading_describes_too_are_cases(spark, data, tmp_path, monkeypatch):
    alike, bad, plain = "Іnitial field report of the Kelаnfell formation", "Â© 2021 Kelanfell survey", "Initial field report of the Kelanfell formation"
    told = f"²nitial field report | Kelànfell formation | © 2021 Kelanfell survey | {plain}"
    monkeypatch.setattr(mojibake, "train", lambda df: ({"en": told.encode()}, 2.0))
    scale = mojibake.Scale({"en": told.encode()}, 2.0)
    assert mojibake.choose(alike, scale) == ("²nitial field report of the Kelànfell formation", 1)
    anchors = [("u1", alike), ("u2", bad + "\xa0"), ("u3", "Dоrford М\ufffdt"), ("u4", plain), ("u5", "Dorford"), ("u1", alike)]
    spark.createDataFrame(anchors, "url string, anchor_text string").write.parquet(f"{tmp_path}/iccra_report_links_full.parquet")
    spark.read.parquet(f"{data}/commons_crop_circle_assertions.parquet").write.parquet(f"{tmp_path}/commons_crop_circle_assertions.parquet")
    got = {r.record_key: r.unified for r in queries.p4_forms(spark, str(tmp_path)).where("table_name = 'iccra_report_links_full'").collect()}
    assert got == {"u1": plain}
    rows = spark.createDataFrame([("a", alike, plain), ("b", bad, None), ("c", alike[:7], "")], "key string, text string, form string")
    assert {r.key for r in mojibake.repair(rows, "key", "text", rival="form").collect()} == {"b"}
    assert {r.key for r in mojibake.repair(rows, "key", "text").collect()} >= {"a", "b"}


def test_what_the_jvm_sifts_out_has_no_reading(spark):
    texts = CLEAN + [bad for bad, _ in garbled()] + ORDINARY + list(ALIKE) + ["Zelpamo±d", "M\ufffdt", "a\x85b", "naïve é", "ß" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts if t], "t string").withColumn("s", mojibake.suspicious(F.col("t"))).collect()
    assert not [r.t for r in rows if not r.s and (mojibake.readings(r.t) or "\ufffd" in r.t)]
    assert sum(r.s for r in rows) < len(rows)


def test_every_reading_is_followed(monkeypatch):
    bad = "é" * 9
    for read in ("cp1252", "cp1252", "cp1252"):
        bad = bad.encode().decode(read)
    scale = mojibake.Scale({}, 2.0)
    assert mojibake.choose(bad, scale) == ("é" * 9, 3)
    tree = {"the garbled text": {f"reading {i:02d}": 1 for i in range(40)}, "reading 39": {"it": 1}}
    monkeypatch.setattr(mojibake, "readings", lambda t: tree.get(t, {}))
    assert mojibake.choose("the garbled text", scale) == ("it", 2)


def test_lower_cased_afterwards():
    assert mojibake.from_utf8("vasfã¸bã¥ch, 45â°", "cp1252") == "vasføbåch, 45°"
    assert mojibake.from_utf8("SÃO MARTINHO “é” naïve", "cp1252") == "SÃO MARTINHO “é” naïve"


ALIKE = {
    "ｎｅａｒ Dorford": "near Dorford", "Dor​ford": "Dorford", "Dor ford": "Dor ford", "café": "café", "Dоrford": "Dorford", "Ρrice": "Price", "ﬁeld": "field", "РDF": "PDF", "ｶﾞ": "ガ", "Gröβe": "Größe",
}
ORDINARY = ["Dorford", "near Price field", "PDF", "Dor ford", "café “quoted” – dash… ½ m² № 5 n.º", "Отчёт о поле", "Αναφορά στο σιτάρι", "日本語レポート 5", "Größe", "", None, "a  b", "tab\tand\nline", "price £5"]


def test_look_alikes_are_found_and_made_one(spark):
    rows = [("t", f"o{i}", t, 1) for i, t in enumerate(ORDINARY)] + [("t", f"a{i}", t, 1) for i, t in enumerate(ALIKE)] + [("t", "a0", next(iter(ALIKE)), 1), ("t", "un", "Xyzzо", 1), ("t", None, "Dоrford", 1)]
    df = spark.createDataFrame(rows, "table_name string, key string, text string, t int")
    got = {r.key: r.unified for r in confusables.unify(df, ["table_name", "key"], "text").collect()}
    assert got == {f"a{i}": v for i, v in enumerate(ALIKE.values())} | {"un": "Xyzzо", None: "Dorford"}
    assert confusables.unify(df.limit(0), ["key"], "text").count() == 0


PLACE = "fid string, date_iso string, place string, region string, country string, country_code string, latitude double, longitude double"


def test_links_between_sources(spark):
    rng = random.Random(6)
    stems = ["Ash", "Kel", "Tor", "Mor", "Dor", "Wim", "Pel", "Sib", "Quen", "Yar"]
    tails = ["ford", "holt", "wald", "kirk", "bach", "stow", "mond", "rick"]
    kinds = ["Down", "Hill", "Wood", "Moor", "Farm", "Cross"]
    known, asked, want = [], [], {}
    for i in range(400):
        name = f"{rng.choice(stems)}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(tails)} {rng.choice(kinds)}"
        y, x, year, month, day = 50 + rng.random() * 3, -3 + rng.random() * 4, rng.randrange(1980, 2020), rng.randrange(4, 9), rng.randrange(1, 18)
        known.append((f"f{i:03d}", f"{year}-{month:02d}-{day:02d}", name, rng.choice(["Wendshire", "Corvale"]), "United Kingdom", "GB", y, x))
        told_ = [("nr " + name.upper(), f"{year}-{month:02d}-{day + 3:02d}", y + 0.002, x), (name[:3] + name[4:], f"{year}-{month:02d}", None, None), (None, f"{year}-{month:02d}-{day:02d}", y, x + 0.004), (name + " (field)", str(year), y, x), (name, None, y - 0.003, x)][i % 5]
        asked.append((f"p{i:03d}", told_[1], told_[0], None, None, None, told_[2], told_[3]))
        want[f"p{i:03d}"] = f"f{i:03d}"
    asked += [("x1", "1950-01-01", known[0][2], None, None, None, None, None), ("x2", None, None, None, None, None, None, None), ("x3", known[1][1], known[1][2], None, None, None, -10.0, 10.0), (None, known[1][1], known[1][2], None, None, None, None, None), asked[0]]
    left, right = spark.createDataFrame(known + known[:3], PLACE), spark.createDataFrame(asked, PLACE.replace("fid", "pid"))
    right = right.withColumn("was", F.concat(F.lit("f"), F.substring("pid", 2, 3)))
    got = {r.pid: r for r in link(left, right, "fid", "pid", "was").collect()}
    right_ = sum(got[k].fid == v for k, v in want.items() if k in got)
    assert not {"x1", "x2", "x3"} & set(got) and right_ >= 0.95 * len(want) and right_ >= 0.98 * len(got)
    assert all(0 <= r.confidence <= 1 for r in got.values())
    assert link(left.limit(0), right, "fid", "pid").count() == 0 and link(left, right.limit(0), "fid", "pid").count() == 0


def test_slips_meet_in_blocks_of_large_tables(spark):
    rng = random.Random(9)
    part = lambda: "".join(rng.choice(["ash", "kel", "tor", "mor", "wim", "pel", "sib", "yar", "lud", "gum"]) for _ in range(2)) + rng.choice(["ford", "holt", "wald", "mond"])
    names = [f"{part()} {rng.choice(['down', 'hill', 'wood', 'moor', 'cross'])}" for _ in range(600)]
    slips = [n[: (at := rng.randrange(1, len(n) - 3))] + n[at + 1 :] if i % 2 else n[: (at := rng.randrange(1, len(n) - 3))] + n[at + 1] + n[at] + n[at + 2 :] for i, n in enumerate(names)]
    rows = [(i, n, s) for i, (n, s) in enumerate(zip(names, slips))]
    df = spark.createDataFrame(rows, "rid long, known string, asked string").selectExpr("*", "'' AS area", "2001 AS year", "DATE '2001-07-05' AS day", "CAST(NULL AS double) AS lat", "CAST(NULL AS double) AS lon")
    sides = [with_tokens(df.withColumn("name", F.col(c))).toPandas() for c in ("known", "asked")]
    for count, bits in ((12_000, 4), (120_000, 8), (1_200_000, 11)):
        space, met = Space(sides[0].to_dict("records") + sides[1].to_dict("records"), np.bincount(np.concatenate(sides[0]["grams"].to_list()).astype(int), minlength=SLOTS) * count / 600, count), []
        for pdf, asked in zip(sides, (False, True)):
            blocks: dict[int, set] = {}
            for out in _keys(space, asked)([pdf]):
                for rid, own in zip(out["rid"], out["blocks"]):
                    blocks.setdefault(rid, set()).update(own)
            met.append(blocks)
        found = sum(bool(met[0][i] & met[1][i]) for i in range(600))
        assert space.year_bits == bits and found >= 0.9 * 600, (count, found)


def test_what_trains_the_vectors_does_not_grow_with_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "TRAIN_RECORDS", 300)
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(24)) + " down"
    known = [(f"f{i:05d}", f"{1980 + i % 40}-07-05", name(), "Wendshire", "United Kingdom", "GB", 50.0 + i / 1e4, -3.0) for i in range(16_000)]
    left, right = spark.createDataFrame(known, PLACE).repartition(32), spark.createDataFrame(known[:50], PLACE.replace("fid", "pid"))
    conf, files = spark.sparkContext._jsc.sc().conf(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    conf.set("spark.driver.maxResultSize", "1m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        assert link(left, right, "fid", "pid").count() == 50
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.set("spark.sql.files.maxPartitionBytes", files)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    records = spark.range(5000).select(F.col("id").alias("rid"), (F.col("id") * 2).alias("v"))
    want = [r.v for r in records.orderBy(F.xxhash64("rid"), "rid").limit(300).collect()]
    assert [r["v"] for r in linkage.drawn(records, 300, ["v"])] == want and len(linkage.drawn(records.limit(20), 300, ["v"])) == 20
