"""Analytics of logs, queues and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the error, without options of the virtual machine that name it.
OUT_OF_MEMORY = r"(?<![A-Za-z0-9_])(?:java\.lang\.)?OutOfMemoryError\b"


def occurrences(text: Column, pattern: str = OUT_OF_MEMORY) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def key_values(line: Column) -> Column:
    """Map of a line's key=value words."""
    return F.map_from_entries(F.transform(F.filter(F.split(line, " "), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value"))))


def nearest_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, the value at place ceil(share * n)) from counts of equal values, so no group is sorted row by row."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    upto = counted.withColumns({"_k": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    return upto.where(F.col("_k") >= F.ceil(F.col("_n") * share)).groupBy(by).agg(F.min(value).alias("at_rank"))


def query_log(log: DataFrame, by: str) -> DataFrame:
    """log: elapsed, bytes. Per client: queries, mean, largest and 95th percentile of elapsed times, result size in MiB."""
    rows = log.groupBy(by).agg(F.count("*").alias("queries"), F.round(F.avg("elapsed")).alias("mean"), F.max("elapsed").alias("most"), F.round(F.avg("bytes") / 1048576, 1).alias("mib"))
    return rows.join(nearest_rank(log, by, "elapsed", 0.95).withColumnRenamed("at_rank", "p95"), by)


def backlog(entries: DataFrame, key: list[str], order: str, hour: Column) -> DataFrame:
    """(hour, entries, duplicates): how many entries came, and how many of them repeat an earlier one exactly."""
    marked = entries.withColumns({"hour": hour, "_first": F.min(order).over(Window.partitionBy(*key))})
    return marked.groupBy("hour").agg(F.count("*").alias("entries"), F.sum((F.col(order) != F.col("_first")).cast("long")).alias("duplicates"))


def most_repeated(entries: DataFrame, key: str, most: int = 5) -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def counter_deltas(samples: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """Adds the counter's growth since the sample before; a fall is a reset."""
    before = F.lag(counter).over(Window.partitionBy(key).orderBy(order))
    return samples.withColumns({"delta": F.col(counter) - before, "reset": F.coalesce(F.col(counter) < before, F.lit(False))})


def normalised(responses: DataFrame, elapsed: Column, duration: Column) -> DataFrame:
    """Adds processing seconds for an hour of media; null without a duration."""
    return responses.withColumn("normalised", F.when(duration > 0, elapsed * 3600 / duration))


def sums(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Sums of numeric key=value fields over all lines, and how many lines there are."""
    kv = lines.select(key_values(F.col("line")).alias("kv"))
    return kv.agg(F.count("*").alias("lines"), *(F.round(F.sum(F.element_at("kv", F.lit(f)).try_cast("double")), 3).alias(f) for f in fields))
