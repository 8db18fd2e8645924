"""Retrieval evaluation, log analytics and comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions.ident import query_name, stem
from peakfold.operators.logs import nearest_rank


def acceptable() -> Column:
    """Of result lines: not itself, score 15, three seconds, over five hits a second, at most 0.7 of seconds empty."""
    d = F.col("stop") - F.col("start")
    return (F.col("query") != F.col("ref")) & (F.col("score") >= 15) & (d >= 3) & (F.col("score") / d > 5) & (1 - F.col("share") <= 0.7)


def symmetric(results: DataFrame) -> DataFrame:
    """Marks results whose counterpart, with query and reference exchanged, is there too."""
    return results.withColumn("symmetric", F.count("*").over(Window.partitionBy(F.least("query", "ref"), F.greatest("query", "ref"))) >= 2)


def rates(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """outcomes: expected, actual (null: none). Shares of true and false positives and negatives."""
    e, a = F.col("expected"), F.col("actual")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return outcomes.groupBy(*by).agg(share(a.isNotNull() & e.isNotNull() & (a == e)).alias("tp"), share(a.isNotNull() & (e.isNull() | (a != e))).alias("fp"), share(a.isNull() & e.isNotNull()).alias("fn"), share(a.isNull() & e.isNull()).alias("tn"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two multisets has over the other."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def latency(log: DataFrame, by: str) -> DataFrame:
    """Count, mean, largest and 95th percentile (nearest rank) of elapsed times."""
    rows = log.groupBy(by).agg(F.count("*").alias("n"), F.avg("elapsed").alias("mean"), F.max("elapsed").alias("most"))
    return rows.join(nearest_rank(log, by, "elapsed", 0.95).withColumnRenamed("at_rank", "p95"), by)


def expected(results: DataFrame) -> DataFrame:
    """results: query, ref (file names). Adds what the query's name says it is cut from, and whether ref is that."""
    rows = results.withColumn("e", query_name(F.col("query")))
    return rows.withColumns({"expected": F.col("e.name"), "change": F.col("e.change"), "factor": F.col("e.factor"), "right": F.coalesce(F.col("e.name") == stem(F.col("ref")), F.lit(False))}).drop("e")


def canonical(results: DataFrame) -> DataFrame:
    """Results in an order that doesn't depend on how they were found."""
    return results.orderBy(F.col("resource_id").cast("string"), "query_start", "query_stop")
