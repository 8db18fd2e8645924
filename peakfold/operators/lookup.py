"""Near-hash lookup: a band join turned into an equality join by expanding the query's hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(prints: DataFrame, reach: int = 2, attribution: str = "last") -> DataFrame:
    """prints: query_id, pos, hash, t1. (query_id, near_hash, original_hash) for every hash within reach.

    attribution "last": a near hash belongs to the last query position that reaches it; "all": to each.
    """
    near = prints.select("query_id", "pos", F.col("hash").alias("original_hash"), F.explode(F.sequence(F.col("hash") - reach, F.col("hash") + reach)).alias("near_hash"))
    if attribution == "all":
        return near.select("query_id", "near_hash", "original_hash")
    if attribution != "last":
        raise ValueError("attribution is last or all")
    return near.groupBy("query_id", "near_hash").agg(F.max_by("original_hash", "pos").alias("original_hash"))


def wanted(prints: DataFrame, reach: int = 2, attribution: str = "last", pitched: bool = False) -> DataFrame:
    """(query_id, original_hash, near_hash, query_time, maybe query_f1): what a query looks for. The last print
    with a hash gives its time."""
    f1 = [F.max_by("f1", "pos").alias("query_f1")] if pitched and "f1" in prints.columns else []
    times = prints.groupBy("query_id", F.col("hash").alias("original_hash")).agg(F.max_by("t1", "pos").alias("query_time"), *f1)
    return expand(prints, reach, attribution).join(times, ["query_id", "original_hash"])


def near_hits(prints: DataFrame, index, reach: int = 2, attribution: str = "last", avoid: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Hits of the index with the time of the query print they belong to; index: rows (hash, resource_id, t1) or posting lists.

    avoid: resource_id of resources that don't count, or query_id and resource_id where each query has its own;
    targets: query_id and resource_id, the only ones that do. Where prints and index have f1, hits have both.
    """
    if not isinstance(index, DataFrame):
        return index.near_hits(prints, reach, attribution, avoid, targets)
    own = avoid is not None and "query_id" in avoid.columns
    if avoid is not None and not own:
        index = index.join(avoid, "resource_id", "left_anti")
    pitched = "f1" in prints.columns and "f1" in index.columns
    asked, on = wanted(prints, reach, attribution, pitched), ["near_hash"]
    if targets is not None:
        asked, on = asked.join(targets.select("query_id", "resource_id"), "query_id"), ["near_hash", "resource_id"]
    more = ["match_f1", "query_f1"] if pitched else []
    rows = index.withColumnsRenamed({"hash": "near_hash", "t1": "match_time", "f1": "match_f1"}).join(asked, on)
    if own:
        rows = rows.join(avoid.select("query_id", "resource_id"), ["query_id", "resource_id"], "left_anti")
    return rows.select("query_id", "original_hash", "near_hash", "resource_id", "match_time", "query_time", *more)


def frequent_hits(prints: DataFrame, index, least: int, reach: int = 2, attribution: str = "last", avoid: DataFrame | None = None, targets: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Hits of the pairs of query and resource that may have ``least``: posting lists count before they make hits, and
    give them a pair at a task where that is asked for (together), in tasks of a bounded number of hits."""
    if isinstance(index, DataFrame) or targets is not None:
        return near_hits(prints, index, reach, attribution, avoid, targets)
    return index.search(prints, least, reach, attribution, avoid, together=together)
