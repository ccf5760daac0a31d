"""Points near other points and in regions (problem 3): curve cells, range join on codes, exact refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import FINE_BITS, cell_bits, chord_of, haversine_m, quantise, spread_bits, unit_vector, with_curve_code
from ..runtime import salted

ROWS_PER_SALT = 20_000


def usable_point(lat: Column, lon: Column) -> Column:
    """Neither null nor NaN, and within the ranges of degrees."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def _with_ranges(p: DataFrame, chord: float, bits: int) -> DataFrame:
    """One row per cell that a ball around the point meets, with the range of codes of the ball's box in it."""
    below, c = FINE_BITS - bits, chord * (1 + 1e-7) + 1e-12
    axes = "xyz"
    p = p.withColumns({f"v{a}": v for a, v in zip(axes, unit_vector(F.col("lat"), F.col("lon")), strict=True)})
    p = p.withColumns({f"lo{a}": quantise(F.col(f"v{a}") - c) for a in axes} | {f"hi{a}": quantise(F.col(f"v{a}") + c) for a in axes})
    p = p.withColumns({f"first{a}": F.shiftright(f"lo{a}", below) for a in axes} | {f"last{a}": F.shiftright(f"hi{a}", below) for a in axes})
    p = p.withColumns({f"two{a}": F.col(f"first{a}") != F.col(f"last{a}") for a in axes})
    seam = {a: F.shiftleft(F.col(f"last{a}"), below) for a in axes}
    p = p.withColumns({f"end{a}": F.when(F.col(f"two{a}"), seam[a] - 1).otherwise(F.col(f"hi{a}")) for a in axes} | {f"seam{a}": seam[a] for a in axes})
    p = spread_bits(p, {f"{k}{a}": F.col(f"{k}{a}") for k in ("first", "last", "lo", "hi", "end", "seam") for a in axes})
    sides = (("first", "lo", "end"), ("last", "seam", "hi"))
    ranges = []
    for x in (0, 1):
        for y in (0, 1):
            for z in (0, 1):
                cell, lo, hi = (
                    F.col(f"{sides[x][k]}x").bitwiseOR(F.shiftleft(f"{sides[y][k]}y", 1)).bitwiseOR(F.shiftleft(f"{sides[z][k]}z", 2)) for k in range(3)
                )
                met = F.lit(True)
                for a, side in zip(axes, (x, y, z), strict=True):
                    met = met & F.col(f"two{a}") if side else met
                ranges.append(F.when(met, F.struct(cell.alias("cell"), lo.alias("lo"), hi.alias("hi"))))
    p = p.withColumn("r", F.explode(F.filter(F.array(*ranges), lambda r: r.isNotNull())))
    return p.select("id", "lat", "lon", "several", "r.cell", "r.lo", "r.hi")


def near_pairs(points: DataFrame, radius_m: float, id_col: str = "id", lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """(id_a, id_b, metres): pairs of different ids with points at most ``radius_m`` apart, id_a < id_b, each once
    with its smallest distance.

    Rows with a null id or an unusable point take no part. Exact repeats count once; an id with several points is
    near whatever any of its points is near. An empty table gives no rows; other columns are ignored. Works over the
    date line and the poles, as cells divide the space around the sphere, not degrees.
    Plan: one shuffle of points and of their covering ranges by cell (hot cells salted), the range condition and the
    exact distance as join conditions inside code generation. Only pairs of ids with several points are deduplicated.
    """
    chord = chord_of(radius_m)
    bits = cell_bits(chord)
    p = (
        points.select(F.col(id_col).cast("string").alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon"))
        .filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon")))
        .distinct()
    )
    several = p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("several"))
    p = p.join(several, "id", "left")
    build = with_curve_code(p, "lat", "lon", "code").withColumn("cell", F.shiftright("code", 3 * (FINE_BITS - bits)))
    probe = _with_ranges(p, chord, bits)
    b, a = salted(build, probe, "cell", "id", ROWS_PER_SALT)
    a, b = a.alias("a"), b.alias("b")
    degrees = radius_m / 6_371_000.0 * 57.29577951308232 * (1 + 1e-6) + 1e-9
    metres = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    hits = a.join(
        b,
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.__salt") == F.col("b.__salt"))
        & F.col("b.code").between(F.col("a.lo"), F.col("a.hi"))
        & (F.abs(F.col("a.lat") - F.col("b.lat")) <= degrees)
        & (F.col("a.id") < F.col("b.id"))
        & (metres <= radius_m),
    ).select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), metres.alias("metres"), F.coalesce("a.several", "b.several", F.lit(False)).alias("several")
    )
    once = hits.filter(~F.col("several")).drop("several")
    return once.unionByName(hits.filter("several").groupBy("id_a", "id_b").agg(F.min("metres").alias("metres")))


#: Cells of a region's box in each direction, at most; sizes of cells are powers of two of a degree, from 2^-14 to 2^8.
CELLS_ACROSS, LEVELS = 8, (-14, 8)


def regions_holding(points: DataFrame, regions: DataFrame, id_col: str = "id", lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """(id, region), each once: the regions that hold a point of the id. ``regions`` has region and ring (an array of
    structs lat, lon: the corners in order, in degrees; edges are straight in degrees and don't cross the date line).

    Rows with a null id or an unusable point and regions with a null name or fewer than three corners take no part; a
    region of several rings is held where any of them holds. Points on an edge may count or not. Empty tables give no rows;
    other columns are ignored. Each region is covered with cells of a size that fits it, so a box of any size has at most
    (CELLS_ACROSS + 1) ** 2 of them; points are placed in a cell of each size that occurs (at most one a level of LEVELS),
    cells are joined by equality, hot ones salted, and the exact test of the ring follows in the JVM.
    """
    spark = points.sparkSession
    p = points.select(F.col(id_col).cast("string").alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon"))
    p = p.filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon"))).distinct()
    r = regions.select(F.col("region").cast("string").alias("region"), "ring").filter("region is not null and size(ring) >= 3")
    side = lambda f, c: f(F.transform("ring", lambda x: x[c]))
    r = r.withColumns({"lat0": side(F.array_min, "lat"), "lat1": side(F.array_max, "lat"), "lon0": side(F.array_min, "lon"), "lon1": side(F.array_max, "lon")})
    across = F.greatest(F.col("lat1") - F.col("lat0"), F.col("lon1") - F.col("lon0"), F.lit(2.0 ** LEVELS[0]))
    r = r.withColumn("level", F.least(F.greatest(F.ceil(F.log2(across / CELLS_ACROSS)), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int"))
    used = [x.level for x in r.select("level").distinct().collect()]  # at most one row a level
    if not used:
        return spark.createDataFrame([], "id string, region string")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    cells = r.withColumn("y", F.explode(F.sequence(at("lat0"), at("lat1")))).withColumn("x", F.explode(F.sequence(at("lon0"), at("lon1")))).withColumn("cell", F.xxhash64("level", "y", "x"))
    placed = p.withColumn("level", F.explode(F.lit(used))).withColumns({"y": at("lat"), "x": at("lon")}).withColumn("cell", F.xxhash64("level", "y", "x"))
    b, a = salted(placed.select("id", "lat", "lon", "cell"), cells.select("region", "ring", "lat0", "lat1", "lon0", "lon1", "cell"), "cell", "id", ROWS_PER_SALT)
    a, b = a.alias("a"), b.alias("b")
    box = F.col("b.lat").between(F.col("a.lat0"), F.col("a.lat1")) & F.col("b.lon").between(F.col("a.lon0"), F.col("a.lon1"))
    hits = b.join(a, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.__salt") == F.col("b.__salt")) & box).select("id", "region", "lat", "lon", "ring")
    last = F.slice("ring", -1, 1)
    edges = F.arrays_zip(F.concat(last, F.slice("ring", F.lit(1), F.size("ring") - 1)).alias("p"), F.col("ring").alias("q"))
    crosses = lambda e: ((e["p"]["lat"] > F.col("lat")) != (e["q"]["lat"] > F.col("lat"))) & (
        F.col("lon") < (e["q"]["lon"] - e["p"]["lon"]) * (F.col("lat") - e["p"]["lat"]) / F.nullif(e["q"]["lat"] - e["p"]["lat"], F.lit(0.0)) + e["p"]["lon"]
    )
    inside = F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e), F.lit(False)))
    return hits.filter(inside).select("id", "region").distinct()
