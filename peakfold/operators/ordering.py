"""Places and sums along an order of all rows, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.session import written


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place, from 0, along the order; rows are dealt by its ranges, and of each range only its size meets the others'."""
    low = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    kept = written(low.withColumn("_p", F.shiftright("_i", 33)), "placed", keep=True)
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row a range
    return kept.join(before, "_p").withColumn("place", F.col("_b") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).drop("_i", "_p", "_b")


def placed_within(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds place, from 0, among the rows of the same key; a key of any size is spread over ranges."""
    all_ = placed(rows, key, *order)
    first = all_.groupBy(key).agg(F.min("place").alias("_f"))
    return all_.join(first, key).withColumn("place", F.col("place") - F.col("_f")).drop("_f")
