"""The proximity join and the raw-record loader against brute force and on edge cases."""

import csv
import io
import math
import random

import pytest

from plantweave.operators.badrows import classify_lines, loaded, rejects
from plantweave.operators.proximity import near_pairs, regions_holding

NUMBERS = ("annual_average_employees", "total_hours_worked")


def metres(a, b):
    f, g = math.radians(a[0]), math.radians(b[0])
    h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def pairs(rows, radius):
    return {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] != b[0] and metres(a[1:], b[1:]) <= radius}


@pytest.mark.parametrize("centre", [(40.0, -100.0), (0.0, 0.0), (51.01, 180.0), (90.0, 0.0), (-90.0, 10.0)])
@pytest.mark.parametrize("radius", [200.0, 30_000.0])
def test_near_pairs_against_brute_force(spark, centre, radius):
    rng = random.Random(7)
    step = radius / 111_000
    rows = []
    for i in range(120):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-3, 3) * step))
        lon = (centre[1] + rng.uniform(-3, 3) * step / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180
        rows.append((f"f{i}", lat, lon))
    got = {(r.id_a, r.id_b) for r in near_pairs(spark.createDataFrame(rows, "id string, lat double, lon double"), radius).collect()}
    assert got == pairs(rows, radius)


def test_near_pairs_edge_cases(spark):
    nan = float("nan")
    rows = [("a", 1.0, 1.0, "x"), ("a", 1.0, 1.0, "x"), ("b", 1.0, 1.0005, None), ("a", 2.0, 2.0, "y"), ("c", 2.0, 2.0, "z"), (None, 1.0, 1.0, "n"), ("d", nan, 1.0, "n"), ("e", 91.0, 1.0, "n"), ("g", 1.0, None, "n")]
    df = spark.createDataFrame(rows, "id string, lat double, lon double, cell string")
    assert [(r.id_a, r.id_b) for r in near_pairs(df, 200).orderBy("id_a", "id_b").collect()] == [("a", "b"), ("a", "c")]
    assert near_pairs(df.limit(0), 200).count() == 0


def test_hot_cell_is_salted(spark, monkeypatch):
    import plantweave.operators.proximity as P

    monkeypatch.setattr(P, "ROWS_PER_SALT", 10)
    rows = [(f"f{i:03d}", 5.0, 5.0) for i in range(60)]
    got = [(r.id_a, r.id_b) for r in near_pairs(spark.createDataFrame(rows, "id string, lat double, lon double"), 200).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)], "id string, lat double, lon double")
    plan = near_pairs(df, 200)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


HEADER = "id,annual_average_employees,note,total_hours_worked"


def reason(line):
    """What the rules say, from a strict reader written apart."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return "broken_quoting"
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + line[i], i + 1
            if i < n and line[i] != ",":
                return "broken_quoting"
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            value, i = line[i:j], j
            if '"' in value:
                return "broken_quoting"
        fields.append(value)
        if i >= n:
            break
        i += 1
    if len(fields) != 4:
        return "column_count"
    import re

    for v in (fields[1], fields[3]):
        v = v.strip(" ")
        if v and not (re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v) and 0 <= float(v) < math.inf):
            return "invalid_value"
    return None


def lines_df(spark, lines):
    rows = [(0, "f", 1, HEADER)] + [(i + 1, "f", i + 2, x) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "line_id long, source_file string, line_no long, line string")


def test_rejects_against_strict_reader(spark):
    rng = random.Random(3)
    pieces = ['"', '""', ",", ",", "a", "12", " 7 ", "1e999", "-1", "-0", "+3.5E+2", "\n", "x y", "NaN", ".5", "5."]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    lines += ['1,2,"a ""b"", c",3', '1,"12",,"3"', "1,2,3,4", '1,2,"open,4', '1,2,x"y,4', "", '""', '1,"2" ,x,3', "1,٣,x,3", "1, ,x, 5 ", "1," + "9" * 400 + ",x,1", '1,2,"' + "a" * 50_000 + '",3']
    got = {r.line_id: r.reason for r in rejects(classify_lines(lines_df(spark, lines), NUMBERS)).collect()}
    assert got == {i + 1: w for i, x in enumerate(lines) if (w := reason(x))}


def test_loaded_values_and_column_order(spark):
    rows = [(1, "a", 1, HEADER), (2, "a", 2, '7, 12 ,"say ""x"", y\nz",3'), (3, "b", 1, "total_hours_worked,id,annual_average_employees,note"), (4, "b", 2, '3e2,"8",,'), (5, "c", 2, "1,2,3,4"), (6, "a", 3, None)]
    df = spark.createDataFrame(rows, "line_id long, source_file string, line_no long, line string").withColumn("errors", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    c = classify_lines(df, NUMBERS)
    got = {r.line_id: r for r in loaded(c, ["id", "note", *NUMBERS], NUMBERS).collect()}
    assert got[2].note == 'say "x", y\nz' and got[2].annual_average_employees == 12.0 and got[2].total_hours_worked == 3.0
    assert got[4].id == "8" and got[4].total_hours_worked == 300.0 and got[4].annual_average_employees is None and got[4].note is None
    assert {r.line_id: r.reason for r in rejects(c).collect()} == {5: "column_count", 6: "column_count"}
    assert rejects(classify_lines(df.limit(0).drop("errors"), NUMBERS)).count() == 0


def test_well_formed_lines_read_as_the_csv_module_does(spark):
    rng = random.Random(11)
    values = [["".join(rng.choice('ab",\n ') for _ in range(rng.randint(0, 6))) for _ in range(2)] for _ in range(100)]
    lines = []
    for a, b in values:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([a, "1", b, "2"])
        lines.append(out.getvalue())
    got = {r.line_id: r for r in loaded(classify_lines(lines_df(spark, lines), NUMBERS), ["id", "note"], NUMBERS).collect()}
    for i, (a, b) in enumerate(values):
        assert (got[i + 1].id, got[i + 1].note) == (a.strip(" ") or None, b.strip(" ") or None)


def test_all_reasons_are_kept(spark):
    got = {r.line_id: r.errors for r in classify_lines(lines_df(spark, ["1,x,n,-2", "1,2,n", "1,x,n,2", '1,x,"n,2']), NUMBERS).collect()}
    assert got == {1: ["invalid_value: annual_average_employees", "invalid_value: total_hours_worked"], 2: ["column_count"], 3: ["invalid_value: annual_average_employees"], 4: ["broken_quoting"]}


def test_regions_against_brute_force(spark):
    rng = random.Random(6)
    points = [(f"p{i}", rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(150)] + [(f"q{i}", 40 + rng.gauss(0, 0.01), -90 + rng.gauss(0, 0.01)) for i in range(150)]
    points += [(None, 40.0, -90.0), ("bad", float("nan"), 1.0), ("out", 91.0, 0.0), ("q0", 0.0, 0.0)]
    rings = {"world": [(-80, -175), (-80, 175), (80, 175), (80, -175)], "tiny": [(39.995, -90.005), (40.0, -89.99), (40.005, -90.005)], "bent": [(0, 0), (30, 10), (5, 10), (30, 40), (-10, 40)], "two": [(39.99, -90.01)], None: [(0, 0), (1, 0), (1, 1)]}
    regions = [(k, [(float(a), float(b)) for a, b in v]) for k, v in rings.items()] + [("tiny", [(50.0, 50.0), (50.0, 51.0), (51.0, 51.0), (51.0, 50.0)])]

    def holds(ring, lat, lon):
        odd = False
        for (a, b), (c, d) in zip([ring[-1], *ring[:-1]], ring):
            if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
                odd = not odd
        return odd

    want = {(i, k) for i, lat, lon in points if i and -90 <= lat <= 90 for k, ring in regions if k and len(ring) > 2 and holds(ring, lat, lon)}
    p = spark.createDataFrame([(*x, 1) for x in points], "id string, lat double, lon double, region int")
    r = spark.createDataFrame([(*x, 2) for x in regions], "region string, ring array<struct<lat:double,lon:double>>, id int")
    got = [tuple(x) for x in regions_holding(p, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({k for _, k in want}) == 3
    assert regions_holding(p.limit(0), r).count() == 0 and regions_holding(p, r.limit(0)).count() == 0
