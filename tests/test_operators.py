"""Reshaping, resolving, rollups, sources and sinks on small fixtures."""

import json
import math
import os
import random
import zipfile
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantweave.operators import reshape as R
from plantweave.operators import resolve as V
from plantweave.operators import rollup as U
from plantweave.sources import files, paged, sinks
from plantweave.streaming.trends import windowed_totals

DEGREE = 1 / 111_194.93


def bucket(*rows):
    return pd.DataFrame([("acc", i, *r) for i, r in enumerate(rows, 1)], columns=["account", "idx", "name", "address_key", "lat", "lon"])


def run(*rows):
    got = V.cluster_batch(bucket(*rows))
    return got[got["idx"].notna()], got[got["review_a"].notna()]


def test_clusters():
    m, r = run(("Acme", None, 40.0, -90.0))
    assert m["tier"].tolist() == ["singleton"] and r.empty and m["lat"].iat[0] == 40.0
    m, r = run(("Acme", "1 A ST", 40.0, -90.0), ("Other", "1 A ST", 40.0 + 30 * DEGREE, -90.0))
    assert m["tier"].tolist() == ["1", "1"] and m["confidence"].tolist() == [0.95, 0.95] and r.empty
    m, r = run(("Acme Metal", None, 40.0, -90.0), ("12_345", None, 40.0 + 30 * DEGREE, -90.0))
    assert m["tier"].tolist() == ["2b", "2b"]
    m, r = run(("Acme Metal", None, 40.0, -90.0), ("Acme Metals", None, 40.0 + 400 * DEGREE, -90.0))
    assert m["tier"].tolist() == ["2", "2"] and m["lat"].iat[0] == pytest.approx(40.0 + 200 * DEGREE)
    m, r = run(("Acme Metal", None, 40.0, -90.0), ("Zebra", None, 40.0 + 400 * DEGREE, -90.0))
    assert m["cluster"].nunique() == 2 and len(r) == 1 and r["metres"].iat[0] == pytest.approx(400, abs=1)
    m, r = run(("Acme", None, 40.0, -90.0), ("Acme", None, 40.0 + 800 * DEGREE, -90.0))
    assert m["cluster"].nunique() == 2 and r.empty
    m, r = run(*(("Acme", None, 40.0 + k * 700 * DEGREE, -90.0) for k in range(4)))
    assert set(m["tier"]) == {"oversized_chain"} and m["lat"].isna().all() and len(r) == 1 and math.isnan(r["similarity"].astype(float).iat[0])


def test_consensus():
    near, far = 40.0 + 10 * DEGREE, 41.0
    m, _ = run(("a", "X", 40.0, -90.0), ("b", "X", near, -90.0), ("c", "X", far, -90.0), ("d", "X", None, None))
    assert m["suspect"].tolist() == [False, False, True, False] and m["lat"].iat[0] == 40.0
    m, _ = run(("a", "X", 40.0, -90.0), ("b", "X", far, -90.0))
    assert m["suspect"].all() and m["lat"].isna().all()


def test_cluster_table(spark):
    rows = [("big", f"{i:04d}", "Acme", "K", 40.0, -90.0) for i in range(12)] + [("a", "1", "Acme", "K", 40.0, -90.0), ("a", "2", "Acme", "K", None, None), ("b", "3", None, None, None, None)]
    df = spark.createDataFrame(rows, "account string, id string, name string, address_key string, lat double, lon double")
    members, review = V.cluster(df, cap=10)
    got = {(r.account, r.id): r for r in members.collect()}
    assert len(got) == len(rows) and {r.tier for k, r in got.items() if k[0] == "big"} == {"singleton"} and len({r.cluster for k, r in got.items() if k[0] == "big"}) == 12
    assert got["a", "1"].tier == "1" and got["a", "1"].cluster == got["a", "2"].cluster and review.count() == 0
    assert V.cluster(df.limit(0))[0].count() == 0


def test_near_in_bucket(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), f"{i:03d}", 40 + rng.random() / 50, -90 + rng.random() / 50) for i in range(80)] + [("x", "n", None, 1.0)]
    df = spark.createDataFrame(rows, "account string, id string, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in V.near_in_bucket(df).collect()}
    import numpy as np

    want = {(a[1], b[1]) for a in rows[:-1] for b in rows[:-1] if a[0] == b[0] and a[1] < b[1] and V._metres(np.array([a[2], b[2]]), np.array([a[3], b[3]]))[0, 1] <= 750}
    assert got == want and want


def test_accounts(spark):
    rows = [("epa", "1", "Boeing Co", None), ("epa", "2", "The Inc", ""), ("osha", None, None, "Acme LLC"), ("osha", "4", None, None)]
    df = spark.createDataFrame(rows, "source string, source_id string, name string, parent string")
    got = [r.account for r in V.assign_accounts(df, {"BOEING": "boeing"}, "name", "parent").collect()]
    assert got == ["boeing", "_unnamed_epa_2", "ACME", "_unnamed_osha_4"]


def test_collapse_and_trend(spark):
    rows = [("a", 2023, "old", "First", 5.0, 2.0), ("a", 2025, "new", "Last", None, 3.0), ("a", 2024, "mid", "Mid", 7.0, None), (None, 2024, "x", "y", 1.0, 1.0), (None, 2023, "w", "z", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, year long, name string, parent string, staff double, dart double")
    c = R.collapse_series(df, "id", "year", ["name", "staff"], ["parent"], ["dart"]).withColumn("trend", R.series_trend(F.col("series"), "dart"))
    got = {r.id: r for r in c.collect()}
    assert (got["a"].name, got["a"].staff, got["a"].parent, got["a"].trend) == ("new", None, "First", "up")
    # Rows without an id share one row, as the inventory asks, without a series.
    assert set(got) == {"a", None} and (got[None].name, got[None].parent, got[None].series) == ("x", "z", None)


def test_last_wins_and_attribution(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), (None, 1, "c"), (None, 3, "d")], "k string, seq int, v string")
    assert {r.v for r in R.last_wins(df, ["k"], [F.col("seq")]).collect()} == {"b", "d"}
    places = spark.createDataFrame([("a", "Rome", "p1"), ("a", "ROME", "p2"), ("a", None, "p3"), ("b", "Rome", "p4")], "acc string, city string, id string")
    awards = spark.createDataFrame([("a", "rome", 5.0), ("a", "Rome", None), ("a", None, 2.0)], "acc string, city string, amount double")
    got = {r.id: (r.total_amount, r.n_amounts, r.shared) for r in R.attributed(places, awards, "acc", ["city"], "amount").collect()}
    assert got == {"p1": (5.0, 2, True), "p2": (5.0, 2, True), "p3": (2.0, 1, False), "p4": (None, None, False)}


def test_rules_lists_pivot(spark):
    df = spark.createDataFrame([("x", ["9", "2"], 1.0), ("y", [], 2.0), ("xy", ["7"], None)], "n string, codes array<string>, v double")
    rules = [(F.col("n").contains("x"), {"d": "one"}), (F.col("n").contains("y"), {"d": "two"})]
    assert [r.d for r in df.select(R.rule_struct(rules).alias("s")).select("s.d").collect()] == ["one", "two", "one"]
    assert [r.v for r in df.select(R.first_listed(F.col("codes"), {"2": "b", "7": "c"}).alias("v")).collect()] == ["b", None, "c"]
    assert R.pivot_max(df, "n", {"all": F.lit(True)}, "v").count() == 3


def test_rollups(spark):
    df = spark.createDataFrame([(1, 1.0), (20, 2.0), (300, None)], "e int, s double")
    assert [(r.threshold, r.passed) for r in U.sweep(df, F.col("e"), [10, 100]).collect()] == [(10.0, 2), (100.0, 1)]
    assert [r.live_score for r in U.live_scores(df, {"s": 0.0}).collect()] == [0.0, 0.0, 0.0]
    assert [r.live_score for r in U.live_scores(df, {"s": 3.0, "e": 1.0}).orderBy("e").collect()] == [1.0, 6.5, 75.0]
    modes = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", None)], "k string, v string")
    assert [(r.k, r.v, r.n) for r in U.most_frequent(modes, "k", "v").collect()] == [("a", "x", 1)]


def test_range_splitting():
    days = {date(2024, 1, 1): 50, date(2024, 1, 9): 4, date(2024, 2, 1): 9}
    count = lambda k, a, b: sum(n for d, n in days.items() if a <= d <= b)
    got = list(paged.leaves("k", date(2024, 1, 1), date(2024, 3, 1), count, above=12))
    assert sum(x.count for x in got) == 63 and [x for x in got if not x.whole] == [paged.Leaf("k", date(2024, 1, 1), date(2024, 1, 1), 50, False)]
    assert all(a.end < b.start for a, b in zip(got, got[1:]))
    assert list(paged.leaves("k", date(2025, 1, 1), date(2025, 3, 1), count)) == []
    assert paged.trailing(date(2024, 12, 31))[0] == date(2023, 1, 1)


def test_paging_and_retries():
    assert list(paged.pages(lambda n: [{"n": n}] * (3 if n < 3 else 1), rows=3)) == [{"n": 1}] * 3 + [{"n": 2}] * 3 + [{"n": 3}]
    assert len(list(paged.pages(lambda n: [{}] * 2, rows=2, most=4))) == 8
    waits, calls = [], iter([ValueError, ValueError, 7])

    def call():
        x = next(calls)
        if x is ValueError:
            raise x
        return x

    assert paged.patiently(call, wait=waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        paged.patiently(lambda: 1 / 0, tries=2, wait=waits.append)


def test_paged_source(spark, tmp_path):
    (tmp_path / "k_a.json").write_text(json.dumps([{"id": 1, "place": {"city": "Rome"}}, {"id": 2}]))
    (tmp_path / "k_b.json").write_text("[]")
    spark.dataSource.register(paged.PagedFiles)
    df = spark.read.format("paged_files").option("path", str(tmp_path)).load()
    nested = df.select(F.from_json("payload", "id long, place struct<city string>").alias("r"))
    assert sorted((r.id, r.city) for r in files.flattened(nested, {"id": "r.id", "city": "r.place.city"}).collect()) == [(1, "Rome"), (2, None)]


def test_geocode_answers(spark):
    lines = ['"1","1 A St","Match","Exact","1 A ST","-90.5,40.25","x"', '"2","2 B St","No_Match"', '"3","q","Match","Exact","Q","bad"']
    got = [(r.id, r.lat, r.lon) for r in paged.geocode_answers(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("id").collect()]
    assert got == [("1", 40.25, -90.5), ("3", None, None)]


def test_csv_modes(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,n\n1,2\n2,abc\n"3 ""q""\nz",4\n')
    schema = "id string, n double"
    from pyspark.sql.types import _parse_datatype_string

    s = _parse_datatype_string(schema)
    assert [(r.id, r.n) for r in files.read_csv(spark, str(path), s).collect()] == [("1", 2.0), ("2", None), ('3 "q"\nz', 4.0)]
    assert files.read_csv(spark, str(path), s, bad="row").count() == 2
    audited = files.read_csv(spark, str(path), s, audit=True).cache()
    assert audited.filter("_corrupt_record is not null").count() == 1
    assert files.read_optional(spark, str(tmp_path / "none.csv"), s).count() == 0
    years = [spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "b int, a int")]
    assert {(r.a, r.b) for r in files.union_years(years, ["a", "b"]).collect()} == {(1, 2), (4, 3)}


def test_zip_download_config(tmp_path):
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("in/x.csv", "a\n1\n")
        z.writestr("readme.txt", "r")
    assert files.extract_members(str(archive), str(tmp_path)) == [str(tmp_path / "x.csv")]
    with zipfile.ZipFile(archive, "a") as z:
        z.writestr("y.csv", "b\n")
    with pytest.raises(ValueError):
        files.extract_members(str(archive), str(tmp_path))
    assert len(files.extract_members(str(archive), str(tmp_path), ["y.csv"])) == 1

    class Answer:
        headers = {"Content-Length": "3"}

        def __init__(self):
            self.left = [b"ab", b"c", b""]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self, _):
            return self.left.pop(0)

    target = str(tmp_path / "t.bin")
    assert files.download("u", target, lambda _: Answer()) == target and open(target, "rb").read() == b"abc"
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    (tmp_path / "c.json").write_text('{"a": 3}')
    assert files.read_config(str(tmp_path / "c.yaml")) == {"a": [1, 2]} and files.read_config(str(tmp_path / "c.json")) == {"a": 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    sinks.replace_table(df, str(tmp_path / "t.parquet"))
    assert set(files.available(spark, str(tmp_path), ["t", "missing"])) == {"t"}
    sinks.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.write_meta(df.agg(F.count("*").alias("n")), str(tmp_path / "m.json")) == {"n": 2} and os.path.exists(tmp_path / "m.json")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {r.k: r.v for r in sinks.upsert_cache(df, new, "k", str(tmp_path / "c")).collect()} == {"a": 1, "b": None, "c": 3}
    assert sinks.report(df).splitlines()[0].split() == ["k", "v"]
    assert files.relation(spark, [], "k string", "empty_one").count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(1, "2024-01-01 05:00:00", "a", 1.0), (2, "2024-01-01 23:00:00", "a", 2.0), (3, "2024-01-02 01:00:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_totals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(spark.table("totals").collect()) == sorted(windowed_totals(df).collect())


def test_diameters_of_groups_of_any_size(spark, tmp_path):
    from plantweave.plans.reference_queries import q_cluster_diameter

    rng = random.Random(4)
    spot = lambda far: (round(rng.uniform(25, 48), 5), round(rng.uniform(-179, 179) if far else rng.uniform(-82.2, -81.9), 5))
    rows = [("US", f"u{i:03}", *spot(False)) for i in range(300)] + [("ALL", f"a{i:03}", *spot(True)) for i in range(90)] + [("TWO", "t2", 40.0, -90.0), ("TWO", "t1", 40.0, -90.0), ("ONE", "o", 1.0, 1.0)]
    rows += [("SAME", f"s{i}", 40.0, -90.0) for i in range(60)] + [("US", "u000", 24.0, -125.0), ("US", "u000", 49.5, -66.0)] + rows[:20] + [("US", f"v{r[1]}", *r[2:]) for r in rows[:300]]
    df = spark.createDataFrame(rows, "grp string, id string, lat double, lon double")
    key = lambda r: (r.grp, r.id_a, r.id_b, round(r.metres, 3))
    plain, cells = (sorted(map(key, V.diameters(df, cap).collect())) for cap in (10_000, 1))
    assert plain == cells
    met = lambda a, b: float(V._metres(pd.Series([a[2], b[2]]).to_numpy(), pd.Series([a[3], b[3]]).to_numpy())[0, 1])
    want = {g: max(met(a, b) for a in rows for b in rows if a[0] == b[0] == g and a[1] < b[1]) for g in ("ALL", "SAME", "TWO")}
    assert {g: m for g, _, _, m in cells if g != "US"} == pytest.approx(want, abs=0.01)
    many = [("BIG", f"b{i:03}", 30.0 + i / 100, -90.0, None, None) for i in range(601)]
    spark.createDataFrame(many, "account_id string, facility_id string, latitude double, longitude double, voc_tons_2020 double, dart_rate double").write.parquet(str(tmp_path / "facilities.parquet"))
    assert [(r.grp, r.metres) for r in q_cluster_diameter(spark, str(tmp_path)).collect()] == [("BIG", pytest.approx(6 * 111_194.93, abs=1))]


def test_neighbours_on_the_whole_globe(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), f"{i:04d}", lat + rng.gauss(0, 0.004), lon + rng.gauss(0, 0.004 / max(math.cos(math.radians(lat)), 0.01))) for i in range(400) for lat, lon in [rng.choice(((0.0, 10.0), (45.0, 179.999), (45.0, -179.999), (-70.0, 20.0), (89.9, 100.0)))]]
    rows = [(a, i, max(-90.0, min(90.0, x)), (y + 180) % 360 - 180) for a, i, x, y in rows]
    df = spark.createDataFrame(rows, "account string, id string, lat double, lon double")

    def metres(p, q):
        f, g = math.radians(p[2]), math.radians(q[2])
        h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))

    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and metres(p, q) <= 750}
    got = [(r.id_a, r.id_b) for r in V.near_in_bucket(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_clusters_of_any_size_against_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    names = ["Acme Metal", "Acme Metals Inc", "Zebra Forge", "12_345", None, "Plant 7"]
    rows = [("big" if i < 120 else "b", f"{i:03d}", rng.choice(names), rng.choice([None, None, None, f"K{rng.randint(0, 40)}"]), 40 + rng.randint(0, 60) * 0.004, -90.0 + rng.randint(0, 2) * 0.0003) for i in range(150)]
    rows += [("b", "x1", "Lone", None, None, None), (None, "x2", "Lone", None, None, None)]
    df = spark.createDataFrame(rows, "account string, id string, name string, address_key string, lat double, lon double")
    parent = {(r[0], r[1]): (r[0], r[1]) for r in rows if r[0]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(rows):
        for q in rows[:i]:
            if not p[0] or p[0] != q[0]:
                continue
            hit = p[3] is not None and p[3] == q[3]
            if not hit and p[4] is not None and q[4] is not None:
                m = V._metres(__import__("numpy").array([p[4], q[4]]), __import__("numpy").array([p[5], q[5]]))[0, 1]
                shaped = V._shaped(p[2] or "") and V._shaped(q[2] or "")
                a, b = V._key(p[2] or ""), V._key(q[2] or "")
                hit = (m <= V.SAME_M and not shaped) or (m <= V.NEAR_M and bool(a and b) and SequenceMatcher(None, a, b).ratio() >= V.ALIKE)
            if hit:
                parent[find((p[0], p[1]))] = find((q[0], q[1]))
    groups = lambda pairs: {frozenset(k for k, c in pairs if c == g) for g in {c for _, c in pairs}}
    got = [((r.account, r.id), r.cluster) for r in V.cluster_large(df).collect()]
    assert len(got) == len(parent) and groups(got) == groups([(k, find(k)) for k in parent])
