"""Alignment of hits: modes of the time difference at both ends, a line through them, and its score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.config import TOLERANT, Matching

KEY = ["query_id", "resource_id"]


def parts(hits: DataFrame, p: Matching = Matching()) -> DataFrame:
    """Hits of resources with enough of them, marked whether they are in the first or last part by query time."""
    order = ["query_time", "match_time", "near_hash"]
    w = Window.partitionBy(*KEY)
    n = F.count("*").over(w)
    out = hits.withColumns({"n": n, "dt": F.col("match_time") - F.col("query_time")}).where(F.col("n") >= p.min_hits_unfiltered)
    size = F.least(F.lit(p.part_size), F.greatest(F.lit(p.min_hits_unfiltered), F.expr(f"n div {p.part_divider}")))
    rank = F.row_number().over(w.orderBy(*order))
    return out.withColumns({"rank": rank, "size": size}).withColumns({"is_first": F.col("rank") <= F.col("size"), "is_last": F.col("rank") > F.col("n") - F.col("size")})


def modes(marked: DataFrame) -> DataFrame:
    """Per resource the most frequent difference of the first part with its first query time (y1, x1), and of
    the last part with its last (y2, x2); of equals the one nearest zero, then the smaller. Where hits have
    frequencies (match_f1, query_f1), also those of the first hit with the first part's difference."""
    pitched = "match_f1" in marked.columns
    by = marked.groupBy(*KEY, "dt").agg(
        F.sum(F.col("is_first").cast("long")).alias("k1"), F.sum(F.col("is_last").cast("long")).alias("k2"),
        F.min(F.when(F.col("is_first"), F.col("query_time"))).alias("x1"), F.max(F.when(F.col("is_last"), F.col("query_time"))).alias("x2"),
        *([F.min_by(F.struct("match_f1", "query_f1"), F.when(F.col("is_first"), F.col("rank"))).alias("f")] if pitched else []),
    )
    best = lambda k: F.struct(F.col(k), -F.abs("dt"), -F.col("dt"))
    more = [F.max_by("f", best("k1")).alias("f")] if pitched else []
    out = by.groupBy(*KEY).agg(F.max_by("dt", best("k1")).alias("y1"), F.max_by("x1", best("k1")).alias("x1"), F.max_by("dt", best("k2")).alias("y2"), F.max_by("x2", best("k2")).alias("x2"), *more)
    return out.select(*KEY, "y1", "x1", "y2", "x2", "f.match_f1", "f.query_f1") if pitched else out


def lines(ends: DataFrame, tolerant: bool = False) -> DataFrame:
    """Slope, offset and time factor; null where both ends are at one query time. tolerant: the factor is that of speed."""
    slope = F.when(F.col("x2") != F.col("x1"), (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    factor = F.when(F.col("slope") != 1, 1 / (1 - F.col("slope"))) if tolerant else 1 - F.col("slope")
    return ends.withColumn("slope", slope).withColumns({"offset": -F.col("x1") * F.col("slope") + F.col("y1"), "time_factor": factor})


def _within(c: str, bounds: tuple[float, float]):
    return (F.col(c) > bounds[0]) & (F.col(c) < bounds[1])


def align(hits: DataFrame, p: Matching = Matching()) -> DataFrame:
    """Matches per query and resource: start, stop, score, time factor, share of seconds with a hit."""
    marked = parts(hits, p)
    line = lines(modes(marked)).where(_within("time_factor", p.time_factor))
    kept = marked.join(line, KEY).where(F.abs(F.col("dt") - (F.col("slope") * F.col("query_time") + F.col("offset"))) <= p.range)
    return scored(kept, p)


def align_tolerant(hits: DataFrame, to_hz, p: Matching = TOLERANT) -> DataFrame:
    """align() for hits with frequencies, whose speed and pitch may differ; to_hz: a bin's frequency as a column."""
    marked = parts(hits, p)
    factor = to_hz(F.col("match_f1")) / to_hz(F.col("query_f1"))
    line = lines(modes(marked), True).withColumn("frequency_factor", factor).where(_within("time_factor", p.time_factor) & _within("frequency_factor", p.frequency_factor))
    kept = marked.join(line.drop("match_f1", "query_f1"), KEY).where(F.abs(F.col("dt") - (F.col("slope") * F.col("query_time") + F.col("offset"))) <= p.range)
    return scored(kept, p, ["frequency_factor"])


def scored(kept: DataFrame, p: Matching, more: list[str] | None = None) -> DataFrame:
    """Matches of hits that lie on their line (query_time, match_time, rank, time_factor); more: columns that are the same for all hits of a match."""
    s = p.seconds_per_frame
    first, last = F.min_by("match_time", "rank"), F.max_by("match_time", "rank")
    out = kept.groupBy(*KEY).agg(
        F.count("*").alias("score"), F.min("query_time").alias("q0"), F.max("query_time").alias("q1"), first.alias("r0"), last.alias("r1"),
        F.first("time_factor").alias("time_factor"), F.collect_set((F.col("match_time") * s).cast("double")).alias("_s"), *(F.first(c).alias(c) for c in more or []),
    )
    out = out.where((F.col("score") > p.min_hits_filtered) & ((F.col("q1") - F.col("q0")) * s >= p.min_duration))
    seconds = F.ceil((F.col("r1") - F.col("r0")) * s)
    covered = F.size(F.array_distinct(F.transform("_s", lambda x: (x - F.col("r0") * s).cast("int"))))
    share = F.when(seconds > 0, 1 - (seconds - covered) / seconds)
    out = out.withColumn("share", share).where(F.col("share") >= p.min_seconds_with_match)
    return out.select(*KEY, (F.col("q0") * s).alias("query_start"), (F.col("q1") * s).alias("query_stop"), (F.col("r0") * s).alias("ref_start"), (F.col("r1") * s).alias("ref_stop"), "score", "time_factor", "share", *(more or []))


def histogram_mode(hits: DataFrame, width: int = 5) -> DataFrame:
    """Fallback: the fullest bin of time differences per resource; of equals the one nearest zero."""
    bins = hits.groupBy(*KEY, F.expr(f"(match_time - query_time) div {width}").alias("bin")).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("hits"), F.abs("bin"), "bin")
    return bins.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def histogram_matches(hits: DataFrame, p: Matching = Matching(), width: int = 5) -> DataFrame:
    """Fallback matches: hits within a bin of the fullest one, where that has more than the least hits; no change of speed."""
    ranked = hits.withColumns({"dt": F.col("match_time") - F.col("query_time"), "rank": F.row_number().over(Window.partitionBy(*KEY).orderBy("query_time", "match_time", "near_hash"))})
    n = F.count("*").over(Window.partitionBy(*KEY))
    enough = ranked.withColumn("n", n).where(F.col("n") >= p.min_hits_unfiltered)
    mode = histogram_mode(hits, width).where(F.col("hits") > p.min_hits_unfiltered).select(*KEY, (F.col("bin") * width).alias("at"))
    kept = enough.join(mode, KEY).where(F.abs(F.col("at") - F.col("dt")) <= width).withColumn("time_factor", F.lit(1.0))
    return scored(kept, p)


def with_fallback(hits: DataFrame, p: Matching = Matching()) -> DataFrame:
    """Matches by a line, and by the histogram for queries that have none of these."""
    found = align(hits, p)
    return found.unionByName(histogram_matches(hits, p).join(found.select("query_id").distinct(), "query_id", "left_anti"))


def with_metadata(matches: DataFrame, catalog: DataFrame, how: str = "inner") -> DataFrame:
    """inner: only resources whose store was completed; left: all, the path null where unknown."""
    meta = catalog.where((F.col("duration") > 0) & (F.col("num_fingerprints") > 0)) if how == "inner" else catalog
    return matches.join(meta.select("resource_id", "path"), "resource_id", how)


def ranked(matches: DataFrame, most: int = 1000) -> DataFrame:
    """The best matches of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "resource_id")
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
