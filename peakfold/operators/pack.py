"""Event points to fingerprints: interval self-joins on a time bucket, and the hash projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakfold.config import Extraction
from peakfold.functions.ident import morton


def _point(df: DataFrame, k: int) -> DataFrame:
    return df.select("resource_id", *(F.col(c).alias(f"{c}{k}") for c in "tfm"))


def _next(left: DataFrame, points: DataFrame, k: int, e: Extraction) -> DataFrame:
    """Joins the points that may follow point k. A right row is in its own time bucket and the one before,
    so the join has an equality on (resource, bucket) and the interval is a residual filter."""
    low, high = e.time_distance
    width = high + 1
    right = _point(points, k + 1).withColumn("_b", F.explode(F.array(F.expr(f"t{k + 1} div {width}"), F.expr(f"t{k + 1} div {width} - 1"))))
    gap, dist = F.col(f"t{k + 1}") - F.col(f"t{k}"), F.abs(F.col(f"f{k + 1}") - F.col(f"f{k}"))
    return left.withColumn("_b", F.expr(f"t{k} div {width}")).join(right, ["resource_id", "_b"]).where(gap.between(low, high) & dist.between(*e.freq_distance)).drop("_b")


def triples(points: DataFrame, e: Extraction = Extraction()) -> DataFrame:
    """points: resource_id, t, f, m. Every ordered triple whose steps are within the distances."""
    return _next(_next(_point(points, 1), points, 1, e), points, 2, e)


def pairs(points: DataFrame, e: Extraction = Extraction()) -> DataFrame:
    """Every ordered pair; the third point repeats the second."""
    return _next(_point(points, 1), points, 1, e).withColumns({f"{c}3": F.col(f"{c}2") for c in "tfm"})


def _flags(shift: int) -> Column:
    c = F.col
    bits = [c("f1") > c("f2"), c("f2") > c("f3"), c("f3") > c("f1"), c("m1") > c("m2"), c("m2") > c("m3"), c("m3") > c("m1"), (c("t2") - c("t1")) > (c("t3") - c("t2")), F.abs(c("f2") - c("f1")) > F.abs(c("f3") - c("f2"))]
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out + F.shiftleft(b.cast("long"), shift + k)
    return out


def _layout(low: Column, f1: Column) -> Column:
    """Bits from low to high: 6 of time, 8 flags, 8 of f1, 6 and 6 of the frequency steps."""
    step = lambda a, b: F.shiftright(F.abs(F.col(a) - F.col(b)), 2).cast("long").bitwiseAND(F.lit(63))
    return low + _flags(6) + F.shiftleft(f1.cast("long").bitwiseAND(F.lit(255)), 14) + F.shiftleft(step("f2", "f1"), 22) + F.shiftleft(step("f3", "f2"), 28)


def duration_hash() -> Column:
    """Hash whose time part is the wrapped duration."""
    return _layout((F.col("t3") - F.col("t1")).cast("long").bitwiseAND(F.lit(63)), F.shiftright("f1", 1))


def ratio_hash() -> Column:
    """Hash whose time part is the ratio of steps, so that it stands changes of speed."""
    ratio = (F.col("t2") - F.col("t1")) / (F.col("t3") - F.col("t1")) * 64
    return _layout(ratio.cast("long").bitwiseAND(F.lit(63)), F.shiftright("f1", 5))


def robust_hash() -> Column:
    """30 bits: logarithms of the ratios of time and frequency steps, interleaved, then order flags and coarse
    frequencies; the last flag adds to the upper bit of the third frequency."""
    c, whole = F.col, 1 << 9
    time, freq = (c("t2") - c("t1")) / (c("t3") - c("t2")), F.abs((c("f2") - c("f1")) / (c("f3") - c("f2")))

    def part(ratio: Column, low: float, high: float) -> Column:
        span = math.log(high / low)
        return F.floor((F.log(ratio) + span) / (2 * span) * whole + 0.5).cast("long")

    out = morton(part(freq, 1, 126), part(time, 2, 30)).bitwiseAND(F.lit((1 << 18) - 1))
    flags = [c("f1") > c("f2"), c("f2") > c("f3"), c("f3") > c("f1"), c("m1") > c("m2"), c("m2") > c("m3"), c("m3") > c("m1")]
    for k, b in enumerate(flags):
        out = out + F.shiftleft(b.cast("long"), 18 + k)
    for k, f in enumerate(("f1", "f2", "f3")):
        out = out + F.shiftleft(F.shiftright(c(f), 7).cast("long").bitwiseAND(F.lit(3)), 24 + 2 * k)
    return out + F.shiftleft(((c("t2") - c("t1")) > (c("t3") - c("t2"))).cast("long"), 29)
