"""Leases of queue entries: which ran out without being renewed or acknowledged, so that the entry has to be given again.

A log has a row for each time an entry (key) is delivered to, renewed or acknowledged by a worker (owner): key,
owner, ts, kind. A delivery and a renewal are a lease each, of ``idle`` seconds; it runs out unless the same owner
is heard of again by its end. Rows without key, owner or ts don't count. Who may renew is decided where the log is
written: a renewal by one who is no longer the owner has to be left out there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DONE = "acknowledged"


def _end(idle: int):
    return F.col("ts") + F.make_dt_interval(secs=F.lit(idle))


def lapsed(log: DataFrame, idle: int, now) -> DataFrame:
    """(key, owner, leased, lapsed) of a log that is at rest; now: the time up to which it tells.

    Rows of one time count once, as an acknowledgement if one of them is. What comes next is looked for in stretches
    of ``idle`` seconds, of which only a lease's own and the one after it matter, so an entry or a worker
    that has very many rows is spread over as many groups as it has stretches.
    """
    rows = log.where("key is not null and owner is not null and ts is not null").groupBy("key", "owner", "ts").agg(F.max((F.col("kind") == DONE).cast("int")).alias("_done"))
    rows = rows.withColumn("_part", F.expr(f"unix_micros(cast(ts as timestamp)) div {idle * 1_000_000}"))
    after = rows.groupBy("key", "owner", (F.col("_part") - 1).alias("_part")).agg(F.min("ts").alias("_after"))
    soon = F.lead("ts").over(Window.partitionBy("key", "owner", "_part").orderBy("ts"))
    met = rows.withColumn("_soon", soon).join(after, ["key", "owner", "_part"], "left").withColumn("_next", F.coalesce("_soon", "_after"))
    out = met.where((F.coalesce("_done", F.lit(0)) == 0) & (_end(idle) < now) & (F.col("_next").isNull() | (F.col("_next") > _end(idle))))
    return out.select("key", "owner", F.col("ts").alias("leased"), _end(idle).alias("lapsed"))


def lapsed_stream(log: DataFrame, again: DataFrame, idle: int, late: str = "1 minute") -> DataFrame:
    """The same of a stream, which is read twice (log, again): a lease comes out once the watermark has passed its end.

    It is an outer join within bounds of time, so its state is what came within ``idle`` and ``late``; it is in
    the checkpoint and outlives executors and restarts.
    """
    # the condition names ts so that it stays behind the watermark, which acknowledgements move on too
    open_ = F.expr(f"kind is null or kind <> '{DONE}' or ts is null")
    leases = log.where("key is not null and owner is not null").withWatermark("ts", late).where(open_).select("key", "owner", "ts").dropDuplicates(["key", "owner", "ts"])
    seen = again.select(F.col("key").alias("_key"), F.col("owner").alias("_owner"), F.col("ts").alias("_ts"), F.col("kind").alias("_kind")).withWatermark("_ts", late)
    in_time = F.expr(f"_key = key and _owner = owner and _ts >= ts and _ts <= ts + interval {idle} seconds and (_ts > ts or _kind = '{DONE}')")
    return leases.join(seen, in_time, "leftOuter").where("_ts is null").select("key", "owner", F.col("ts").alias("leased"), _end(idle).alias("lapsed"))
