"""Assembly, percentiles with hot keys, texts, the paged service, configs and the shell entry."""

import json
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from plantweave import __main__ as shell
from plantweave import runtime
from plantweave.functions import stats as S
from plantweave.functions import text as T
from plantweave.operators import assemble as A
from plantweave.operators import reshape as R
from plantweave.sources import files, paged, sinks


def test_places_from_members(spark):
    rows = [
        ("a", 1, "m2", "osha", None, None, 5.0, False), ("a", 1, "m1", "epa", "First", None, None, None), ("a", 1, "m3", "osha", "Third", 7.0, None, True), (None, 1, "m4", "epa", "Nobody's", None, None, None), ("b", 1, "m1", "epa", None, float("inf"), None, False),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, c int, member_id string, source string, name string, voc double, heads double, permit boolean, n_members string")
    got = {r.k: r for r in A.assemble_places(df, ["k", "c"], "member_id", ["name"], ["voc"], ["heads"], {"any_permit": F.col("permit")}).collect()}
    assert got["a"].name == "First" and got["a"].voc == 7.0 and got["a"].heads == 5.0 and got["a"].any_permit and got["a"].member_ids == ["m1", "m2", "m3"] and got["a"].sources == ["epa", "osha"]
    assert got["b"].name is None and math.isinf(got["b"].voc) and not got["b"].any_permit and got[None].n_members == 1
    reason = df.groupBy("k").agg(A.first_reason({"emits": F.col("voc") > 0, "heads": F.col("heads") > 1}, "member_id").alias("r"))
    assert {r.k: r.r for r in reason.collect()} == {"a": "heads", "b": "emits", None: None}
    assert A.assemble_places(df.limit(0), ["k"], "member_id", ["name"]).count() == 0


def test_accounts_patterns_and_notes(spark):
    places = spark.createDataFrame([("a", "One", 1, True, "untouched"), ("a", "Two", 0, None, "untouched"), ("b", None, 0, True, "installed")], "acc string, name string, o int, q boolean, s string")
    pending = spark.createDataFrame([("a",), ("a",), ("c",)], "acc string")
    got = {r.acc: r for r in A.assemble_accounts(places, pending, "acc", "name", "o", F.col("q"), F.col("s") == "untouched", {"b": "Named"}).collect()}
    assert set(got) == {"a", "b"} and got["a"].name == "Two" and tuple(got["a"])[2:] == (2, 1, 1, 2) and got["b"].name == "Named" and tuple(got["b"])[2:] == (1, 1, 0, 0)
    df = spark.createDataFrame([("a", "The Acme Works"), ("a", "ZED-7"), ("a", "Acmeville"), ("b", None), (None, "Acme")], "acc string, n string")
    hits = {r.acc: r.hits for r in A.pattern_hits(df, "acc", F.col("n"), {"z": ["ZED"], "acme": ["ACME"]}).collect()}
    assert hits == {"a": ["acme", "z"], None: ["acme"]}
    notes = spark.createDataFrame([(None, None, None), (5.0, 2, True), (1234.4, 3, False)], "t double, n int, s boolean").select(A.attribution_note(F.col("t"), F.col("n"), F.col("s")).alias("x"))
    assert [r.x for r in notes.collect()] == ["no awards in this city", "2 awards shared by places in this city", "3 awards, 1,234"]
    caps = spark.createDataFrame([(100.0,), (None,), (9_999.0,)], "h double").select(A.capacity(F.col("h"), F.lit(0.2), 4, F.lit(12)).alias("c"))
    assert [r.c for r in caps.collect()] == [5, None, 12]


def test_points_are_filled_where_missing(spark):
    df = spark.createDataFrame([("k1", None, None), ("k1", 1.0, 2.0), ("k2", None, None), (None, None, None)], "k string, lat double, lon double")
    lookup = spark.createDataFrame([("k1", 9.0, 8.0), ("k3", 1.0, 1.0)], "k string, lat double, lon double")
    got = sorted(((r.k, r.lat, r.lon, r.filled) for r in A.filled(df, lookup, ["k"], ["lat", "lon"], F.col("lat").isNull()).collect()), key=str)
    assert got == sorted([("k1", 9.0, 8.0, True), ("k1", 1.0, 2.0, False), ("k2", None, None, False), (None, None, None, False)], key=str)


def test_percentiles_with_hot_values_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, 0.0, 0.0, 0.0, -0.0, rng.random()]), rng.choice([1, 2, None])) for i in range(600)] + [(601, "one", 5.0, None)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y int")
    got = {r.id: r for r in S.group_percentiles(df, [("x", "g", "px"), ("y", None, "py")]).collect()}

    def want(values, v):
        below, same = sum(w < v for w in values), sum(w == v for w in values)
        return (below + (same - 1) / 2) / max(len(values) - 1, 1) * 100

    assert len(got) == len(rows)
    for i, g, x, y in rows:
        own = [r[2] for r in rows if r[1] == g and r[2] is not None]
        assert got[i].px == (pytest.approx(want(own, x)) if g is not None and x is not None else None)
        assert got[i].py == (pytest.approx(want([r[3] for r in rows if r[3] is not None], y)) if y is not None else None)
    medians = {r.g: (r.median, r.n) for r in S.exact_median(df, "g", "x").collect()}
    import statistics

    for g in ("a", "b", "one"):
        own = [r[2] for r in rows if r[1] == g and r[2] is not None]
        assert medians[g] == (pytest.approx(statistics.median(own)), len(own))


def test_strict_numbers(spark):
    df = spark.createDataFrame([("12",), (None,), (" 7",)], "t string")
    assert [r[0] for r in df.select(S.strict_long(F.col("t"))).collect()][:2] == [12, None]
    with pytest.raises(Exception, match="not a whole number"):
        spark.createDataFrame([("12x",)], "t string").select(S.strict_long(F.col("t"))).collect()


def test_texts(spark):
    money = spark.createDataFrame([(1.23e9,), (4.56e6,), (7_890.0,), (12.0,), (None,)], "x double").select(T.money(F.col("x")).alias("m"))
    assert [r.m for r in money.collect()] == ["$1.23B", "$4.6M", "$8K", "$12", None]
    names = spark.createDataFrame([(" U.S. Navy ", False), ("Acme", True), (None, False)], "n string, c boolean").select(T.badge(F.col("n"), ["u.s. navy"], F.col("c")).alias("b"))
    assert [r.b for r in names.collect()] == ["government", "customer", "prospect"]
    why = spark.range(1).select(T.reasons(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.lit("b")).alias("x"), T.reasons(F.lit(None).cast("string")).alias("y")).first()
    assert why.x == "a; b" and why.y == ""
    assert [r.x for r in spark.createDataFrame([("TX",), ("DC",), ("ZZ",), (None,)], "s string").select(T.region_of(F.col("s")).alias("x")).collect()] == ["Southwest", "Southeast", None, None]
    rows = [("12 North Main Street, Suite 4", "Town ", "ga", "12345-6789"), ("PO Box 7", "Town", "GA", "1"), ("", "T", "GA", "1"), (None, None, None, None), ("7A Oak Ave #3", None, "GA", None)]
    keys = spark.createDataFrame(rows, "a string, c string, s string, z string").select(T.address_key(F.col("a"), F.col("c"), F.col("s"), F.col("z")).alias("k"))
    assert [r.k for r in keys.collect()] == ["12 N MAIN ST, TOWN GA 12345", None, None, None, "7A OAK AVE, GA"]


def test_series_of_rows_without_id(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 2, None, None), (None, 1, 1.0, "n"), (None, 3, 1.0, "m")], "k string, year int, d double, name string")
    got = {r.k: r for r in R.collapse_series(df, "k", "year", ["name"], [], ["d"]).collect()}
    assert got["a"].name is None and len(got["a"].series) == 2 and got[None].name == "m" and got[None].series is None


class FakeService:
    def count(self, key, start, end):
        if key == "down":
            raise RuntimeError("no answer")
        return (end - start).days * (4_000 if key == "big" else 1)

    def page(self, key, start, end, number, sort):
        if key == "broken" and number == 2:
            raise RuntimeError("cut off")
        rows = 100 if number == 1 or key == "big" and number < 3 else 1
        return [{"key": key, "from": start.isoformat(), "number": number, "sort": sort}] * rows


def service():
    return FakeService()


def test_paged_service(spark, tmp_path):
    spark.dataSource.register(paged.PagedService)
    options = {"service": "tests.test_composites:service", "keys": "big,small,down,broken", "start": "2024-01-01", "end": "2024-01-03", "sort": "amount desc", "cache": str(tmp_path), "wait": "0.001"}
    df = spark.read.format("paged_service").options(**options).load()
    rows = df.collect()
    ok = [json.loads(r.payload) for r in rows if r.error is None]
    assert sum(x["key"] == "small" for x in ok) == 101 and {x["from"] for x in ok if x["key"] == "big"} == {"2024-01-01"} and all(x["sort"] == "amount desc" for x in ok)
    failed = {(r.key, r.error) for r in paged.failed_ranges(df).collect()}
    assert failed == {("down", "RuntimeError: no answer"), ("broken", "RuntimeError: cut off")}
    cached = sorted(p.name for p in tmp_path.iterdir())
    assert any(n.startswith("small_2024-01-01") for n in cached) and not any(n.startswith(("broken", "down")) or n.endswith(".part") for n in cached)
    for p in tmp_path.glob("small*"):
        p.write_text('[{"key": "small", "cached": true}]')
    again = [json.loads(r.payload) for r in df.filter("key = 'small'").collect()]
    assert again == [{"key": "small", "cached": True}]
    assert spark.read.format("paged_service").options(**(options | {"keys": "small", "start": "2024-01-01", "end": "2024-01-01"})).load().count() == 0
    assert paged.trailing(date(2024, 1, 10), 9) == (date(2024, 1, 1), date(2024, 1, 10))


def test_config_as_dimension(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"verticals": {"air": {"codes": ["336411", 336413], "ratio": 0.2}, "coat": {"codes": ["332812"]}}}))
    got = {(r.code, r.vertical, r.ratio) for r in files.config_dimension(spark, str(path)).collect()}
    assert got == {("336411", "air", 0.2), ("336413", "air", 0.2), ("332812", "coat", None)}
    path.write_text(json.dumps({"verticals": {"a": {"codes": ["1"]}, "b": {"codes": ["1"]}}}))
    with pytest.raises(ValueError, match="code 1"):
        files.config_dimension(spark, str(path))


def test_meta_with_time(spark, tmp_path):
    meta = sinks.write_meta(spark.range(1).selectExpr("3 as n"), str(tmp_path / "m.json"), "generated_at")
    assert meta["n"] == 3 and meta["generated_at"].endswith("Z") and json.loads((tmp_path / "m.json").read_text()) == meta


def test_shared_folder(spark, tmp_path):
    assert runtime.shared_folder(spark) and runtime.exists(spark, f"file://{tmp_path}") and not runtime.exists(spark, f"file://{tmp_path}/none")

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Empty:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Empty

                    return Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Session)


def test_shell(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a", 5.0)], "c_custkey long, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert shell.main(["list"]) == 0 and "q_topn" in capsys.readouterr().out
    assert shell.main(["run", "q_topn", str(tmp_path), str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(SystemExit):
        shell.main(["run", "none", str(tmp_path)])


def test_tables_no_longer_needed_are_deleted(spark):
    mark = runtime.tables_written()
    a, b = runtime.cut(spark.range(3)), runtime.cut(spark.range(4))
    c = runtime.cut(a.union(b))
    paths = [x.__dict__["_table"] for x in (a, b, c)]
    runtime.keep_only(mark, c)
    assert [runtime.exists(spark, p) for p in paths] == [False, False, True] and c.count() == 7 and runtime.tables_written() == mark + 1
