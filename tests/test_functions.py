"""Column functions against the examples they follow and small independent versions."""

import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plantweave.functions import stats as S
from plantweave.functions import text as T


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a " + kind + ("" if not isinstance(rows[0], tuple) else ", b " + kind))
    return [r.v for r in df.withColumn("v", make).orderBy("i").select("v").collect()]


def test_company_keys(spark):
    assert values(spark, ["Boeing Company", "The Boeing Company", "BOEING CO", "A & B, Inc.", None, "Oshkosh Corporation"], T.company_key(F.col("a"))) == ["BOEING", "BOEING", "BOEING", "A AND B", "", "OSHKOSH"]


def test_name_similarity(spark):
    pairs = [("Boeing Distribution Services", "Boeing Services Distribution"), ("Alpha Metal", "Alfa Metals Inc"), ("", "x"), (None, "x")]
    want = []
    for a, b in pairs:
        x, y = (" ".join(sorted(t.upper().replace("INC", "").split())) if t else "" for t in (a, b))
        want.append(SequenceMatcher(None, x, y).ratio() if x and y else 0.0)
    assert values(spark, pairs, T.name_similarity(F.col("a"), F.col("b"))) == pytest.approx(want)


def test_identity(spark):
    rows = ["PIONEER METAL FINISHING CORP - OSHKOSH DIV", "OSHKOSH DEFENSE, LLC - WEST PLANT", "WA317937871 - OSHKOSH", "ELECTRO-MOTIVE", "The Oshkosh Works", "OSHKOSHER", None]
    assert values(spark, rows, T.leads_with(F.col("a"), "Oshkosh")) == [False, True, True, False, True, False, False]
    assert values(spark, ["92615 - ACME", "ELECTRO-MOTIVE"], T.identity_prefix(F.col("a"))) == ["ACME", "ELECTRO-MOTIVE"]


def test_company_shape(spark):
    rows = ["Auburn, WA (WA001)", "Plant 1", "8403_19144", "ab", None, "Acme Metals", "Main Facility", "Foo, Co", "Auburn, WA"]
    assert values(spark, rows, T.company_shaped(F.col("a"))) == [False, False, False, False, False, True, False, False, False]


def test_displayable(spark):
    rows = ["Northland Dr.", "Lyndon Steel Company, LP", "124 Gwyn Dr", "Plant 1", "8403_19144", "Jamestown", None, "hq #2"]
    assert values(spark, rows, T.displayable(F.col("a"))) == [False, True, False, False, False, True, False, False]


def test_ordinals_and_sentences(spark):
    assert values(spark, [1, 2, 3, 4, 11, 12, 21, 111, 112, 123], T.ordinal(F.col("a")), "int") == ["1st", "2nd", "3rd", "4th", "11th", "12th", "21st", "111th", "112th", "123rd"]
    assert values(spark, ["x", None], T.sentences(F.col("a"), F.when(F.col("a").isNotNull(), "y"), default="none")) == ["x. y.", "none"]


def average_rank(xs):
    known = sorted(x for x in xs if x is not None)
    return [None if x is None else (sum(k < x for k in known) + (sum(k == x for k in known) - 1) / 2) / max(len(known) - 1, 1) * 100 for x in xs]


def test_percentiles_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice([None, 1.0, 2.0, 2.0, 3.5, 9.0])) for i in range(200)] + [(999, "alone", 4.0)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    got = {r.i: r.pct for r in S.group_percentile(df, "v", "g", "pct").collect()}
    for g in ("p", "q", "alone"):
        own = [r for r in rows if r[1] == g]
        for r, want in zip(own, average_rank([r[2] for r in own]), strict=True):
            assert got[r[0]] == (None if want is None else pytest.approx(want))
    assert all(got[r[0]] is None for r in rows if r[1] is None) and got[999] == 0.0
    whole = {r.i: r.pct for r in S.group_percentile(df, "v", None, "pct").collect()}
    for r, want in zip(rows, average_rank([r[2] for r in rows]), strict=True):
        assert whole[r[0]] == (None if want is None else pytest.approx(want))


def test_upper_median(spark):
    rows = [("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0), ("b", 6.0)] + [("c", x) for x in (7.0, 7.0, 9.0)]
    got = {r.g: (r.upper_median, r.n) for r in S.upper_median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {"a": (3.0, 4), "c": (7.0, 3)} and got["a"][0] == statistics.median_high([1, 2, 3, 4])


def test_bands_interpolation_trend(spark):
    bands = [(9, 10.0), (19, 25.0), (None, 100.0)]
    assert values(spark, [None, 9.0, 9.5, 500.0], S.band_score(F.col("a"), bands), "double") == [0.0, 10.0, 25.0, 100.0]
    points = [(0, 12), (20, 16), (45, 24)]
    assert values(spark, [-1.0, 0.0, 10.0, 20.0, 44.9, 99.0], S.interpolated(F.col("a"), points), "double") == [12, 12, 14, 16, 23, 24]
    rows = [(100.0, 105.0), (100.0, 105.1), (100.0, 95.0), (100.0, 94.0), (0.0, 5.0), (None, 1.0)]
    assert values(spark, rows, S.trend(S.relative_change(F.col("a"), F.col("b"))), "double") == ["flat", "up", "flat", "down", "no_data", "no_data"]
    assert values(spark, [(3.0, 0.0), (3.0, 200_000.0), (None, 5.0)], S.rate(F.col("a"), F.col("b")), "double") == [None, 3.0, None]


def test_first_estimate(spark):
    value, basis = S.first_estimate(("one", F.col("a")), ("two", F.col("b")))
    assert values(spark, [(1.0, 2.0), (0.0, 2.0), (None, 0.0)], value, "double") == [1.0, 2.0, 0.0]
    assert values(spark, [(1.0, 2.0), (0.0, 2.0), (None, 0.0)], basis, "double") == ["one", "two", "no_estimate"]
    with pytest.raises(ValueError):
        S.weighted({"a": 0.5})


def test_positions(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(300)]
    got = {r.i: r.pos for r in S.positions(spark.createDataFrame(rows, "i int, v int"), [F.desc("v"), F.col("i")], "pos", 7).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
