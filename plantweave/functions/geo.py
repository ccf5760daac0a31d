"""Column functions on the sphere."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Bits of a quantised coordinate; three of them interleave into one non-negative 60-bit code.
FINE_BITS = 20


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees; null if any input is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere: free of poles and of the date line, unlike degrees."""
    f, g = F.radians(lat), F.radians(lon)
    return F.cos(f) * F.cos(g), F.cos(f) * F.sin(g), F.sin(f)


def quantise(x: Column) -> Column:
    """A coordinate in [-1, 1] as an integer of FINE_BITS bits; beyond the ends it is clamped."""
    top = 1 << FINE_BITS
    return F.least(F.greatest(F.floor((x + 1.0) * (top / 2)), F.lit(0)), F.lit(top - 1)).cast("long")


#: Shift and mask of each step that moves bit i to bit 3i, halving the distance moved.
_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def spread_bits(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds the columns with bit i of each moved to bit 3i. Each step is a projection of its own, as an expression
    that holds the earlier steps twice would grow to 32 copies of its input."""
    df = df.withColumns(dict(columns))
    for shift, mask in _STEPS:
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(F.col(c), shift)).bitwiseAND(F.lit(mask)) for c in columns})
    return df


def with_curve_code(df: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """Adds the Z-order code of each point. It rises with each coordinate, so all points of a box have codes between
    those of its least and greatest corner."""
    axes = unit_vector(F.col(lat), F.col(lon))
    df = spread_bits(df, {f"__{a}": quantise(v) for a, v in zip("xyz", axes, strict=True)})
    code = F.col("__x").bitwiseOR(F.shiftleft("__y", 1)).bitwiseOR(F.shiftleft("__z", 2))
    return df.withColumn(name, code).drop("__x", "__y", "__z")


def cell_bits(chord: float) -> int:
    """Bits per coordinate of the smallest cells that are at least twice ``chord`` wide, so that a ball of that
    radius meets at most two of them in each direction."""
    return max(0, min(FINE_BITS, int(math.floor(math.log2(1.0 / chord))))) if chord > 0 else FINE_BITS


def chord_of(radius_m: float) -> float:
    """Straight distance on the unit sphere of points ``radius_m`` apart along it."""
    return 2 * math.sin(min(math.pi / 2, radius_m / (2 * EARTH_RADIUS_M)))
