"""Monitoring of long recordings: windows, clusters of detections, gaps and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.config import Matching, Monitoring
from peakfold.operators import align, blocks, gates, lookup
from peakfold.session import written


def hops(total: str, step: int = 30, overlap: int = 10) -> Column:
    """Starts of overlapping windows while start + step < total; a shorter tail has none."""
    hop = step - overlap
    last = F.expr(f"cast(ceil(({total} - {step}) / {hop}.0) as int) - 1")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * hop)).otherwise(F.array().cast("array<int>"))


def fine_hops(start: str, stop: str, fine: int = 15, overlap: int = 5) -> Column:
    """Starts of windows that end within [start, stop]."""
    hop = fine - overlap
    n = F.floor((F.col(stop) - F.col(start) - fine) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda k: F.col(start) + k * hop)).otherwise(F.array().cast("array<double>"))


def sample_windows(total: str, length: int = 30, stride: int = 29) -> Column:
    """Windows over a long recording, and one more at its very end."""
    last = F.expr(f"greatest(cast(floor(({total} - {length}) / {stride}.0) as int), 0)")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), last), lambda k: (k * stride).cast("double")), F.array(F.greatest(F.col(total) - length, F.lit(0)).cast("double"))))


def clusters(found: DataFrame, gap, key: str = "id") -> DataFrame:
    """Numbers runs of detections (key, start, stop): a new one where the start is over gap after the previous stop."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    new = (F.col("start") - F.lag("stop").over(w) > gap).cast("int")
    return found.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def cluster_rows(marked: DataFrame, key: str = "id") -> DataFrame:
    return marked.groupBy(key, "cluster").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("score").alias("score"), F.count("*").alias("hits"))


def envelopes(found: DataFrame, key: str = "id") -> DataFrame:
    return found.groupBy(key).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("score").alias("score"), F.avg("pct").alias("mean_pct"), F.max("pct").alias("best_pct"), F.count("*").alias("hits"))


def accepted(score: Column, best_pct: Column, min_score: float = 20, min_pct: float = 0.5) -> Column:
    """By total score and the best window, not the mean one."""
    return (score >= min_score) & (best_pct >= min_pct)


def gaps(found: DataFrame, total: str, key: str = "id") -> DataFrame:
    """Parts of [0, total] that no detection covers."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    inner = found.select(key, F.greatest(F.coalesce(seen, F.lit(0)), F.lit(0)).alias("gap_start"), F.col("start").alias("gap_stop")).where("gap_stop > gap_start")
    tail = found.groupBy(key).agg(F.max("stop").alias("gap_start"), F.max(total).alias("gap_stop")).where("gap_stop > gap_start")
    return inner.unionByName(tail)


def outside(inner: DataFrame, outer: DataFrame, keys: list[str], slack: float, width: float) -> DataFrame:
    """Rows of inner that no row of outer with the same keys contains within the slack.

    A row of outer is in each stretch of time of ``width`` that it reaches, one of inner in that of its start, so
    the join has an equality on (keys, stretch) and a key's rows are compared with those of about their time alone.
    """
    at = lambda x: F.floor(x / width).cast("long")
    spans = outer.select(*keys, F.col("start").alias("_a"), F.col("stop").alias("_z")).where(F.col("_z") + slack >= F.col("_a") - slack)
    o = spans.withColumn("_b", F.explode(F.sequence(at(F.col("_a") - slack), at(F.col("_z") + slack)))).alias("o")
    i = inner.withColumn("_b", at(F.col("start"))).alias("i")
    on = F.col("o._b") == F.col("i._b")
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"i.{k}"))
    return i.join(o, on & (F.col("i.start") >= F.col("o._a") - slack) & (F.col("i.stop") <= F.col("o._z") + slack), "left_anti").drop("_b")


def uncovered(second: DataFrame, first: DataFrame, slack: float = 5.0, key: str = "id", width: float = 7200.0) -> DataFrame:
    """Second-pass rows that no first-pass row of the same track contains within the slack; stops aren't before starts."""
    return outside(second, first, [key], slack, width)


def in_every_window(found: DataFrame, windows: int, slack: float = 2.0, key: str = "id") -> DataFrame:
    """Tracks found in each of the windows (key, win, shift), aligned within the slack of the first."""
    base = F.min_by("shift", "win").over(Window.partitionBy(key))
    ok = found.withColumn("_b", base).where(F.abs(F.col("shift") - F.col("_b")) <= slack)
    return ok.groupBy(key).agg(F.countDistinct("win").alias("n")).where(F.col("n") == windows).select(key)


def window_prints(prints: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """prints: recording, hash, t1; windows: query_id, recording, at, frames. The windows' query prints, with
    times from each window's start. A window is in each bucket of ``width`` frames that it meets, so the join
    has an equality on (recording, bucket) and the bounds are a residual filter."""
    spans = windows.withColumn("_b", F.explode(F.sequence(F.expr(f"at div {width}"), F.expr(f"(at + frames - 1) div {width}"))))
    met = prints.withColumn("_b", F.expr(f"t1 div {width}")).join(spans, ["recording", "_b"]).where("t1 >= at and t1 < at + frames")
    return met.select("query_id", F.col("t1").alias("pos"), "hash", (F.col("t1") - F.col("at")).alias("t1"))


def detect(prints: DataFrame, windows: DataFrame, index, match: Matching, targets: DataFrame | None = None, avoid: DataFrame | None = None) -> DataFrame:
    """What each window of the recordings matches, in frames of the recording: start, stop, and of the
    resource ref_start, ref_stop. index: rows, posting lists or whole resources, of which all are looked at; avoid: recording and resource_id that don't count."""
    width = int(round(30 / match.seconds_per_frame))
    own = None if avoid is None else windows.select("query_id", "recording").join(avoid, "recording").select("query_id", "resource_id")
    asked = window_prints(prints, windows, width)
    if isinstance(index, blocks.Whole):
        found = blocks.align_all(asked, index.resources, match)
        found = found if own is None else found.join(own, align.KEY, "left_anti")
        found = found if targets is None else found.join(targets, align.KEY, "left_semi")
    else:
        found = align.align(lookup.frequent_hits(asked, index, match.min_hits_unfiltered, avoid=own, targets=targets, together=True), match)
    frames = lambda c: F.round(F.col(c) / match.seconds_per_frame).cast("long")
    out = found.join(windows, "query_id")
    return out.select("query_id", "recording", "resource_id", (frames("query_start") + F.col("at")).alias("start"), (frames("query_stop") + F.col("at")).alias("stop"), frames("ref_start").alias("ref_start"), frames("ref_stop").alias("ref_stop"), "score", "time_factor", "share")


def coarse_windows(recordings: DataFrame, m: Monitoring, fps: float) -> DataFrame:
    """recordings: recording, total (frames). Windows of the first pass."""
    step, hop = int(m.step * fps), int((m.step - m.overlap) * fps)
    at = F.when(F.col("total") > step, F.sequence(F.lit(0).cast("long"), F.expr(f"(total - {step} - 1) div {hop}")))
    rows = recordings.select("recording", F.explode(at).alias("k")).select("recording", (F.col("k") * hop).alias("at"), F.lit(step).alias("frames"))
    return rows.withColumn("query_id", F.concat_ws("/", "recording", "at"))


def fine_windows(first: DataFrame, recordings: DataFrame, m: Monitoring, fps: float) -> DataFrame:
    """Windows of the second pass, in gaps of the first one's detections; recordings without any have none."""
    step, hop = int(m.fine * fps), int((m.fine - m.fine_overlap) * fps)
    found = first.join(recordings, "recording").select(F.col("recording").alias("id"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), "total")
    open_ = gaps(found, "total").where((F.col("gap_stop") - F.col("gap_start")).between(m.rescan[0] * fps, m.rescan[1] * fps))
    k = F.sequence(F.lit(0).cast("long"), F.floor((F.col("gap_stop") - F.col("gap_start") - step) / hop).cast("long"))
    rows = open_.where(F.col("gap_stop") - F.col("gap_start") >= step).select(F.col("id").alias("recording"), "gap_start", F.explode(k).alias("k"))
    out = rows.select("recording", (F.col("gap_start").cast("long") + F.col("k") * hop).alias("at"), F.lit(step).alias("frames"))
    return out.withColumn("query_id", F.concat_ws("/", "recording", "at"))


def merged(first: DataFrame, second: DataFrame, slack: int) -> DataFrame:
    """Both passes' detections, of the second those that no first one of the resource contains within the slack."""
    return first.unionByName(outside(second, first, ["recording", "resource_id"], slack, 60 * max(1, slack)))


def occurrences(found: DataFrame, durations: DataFrame, m: Monitoring, fps: float) -> DataFrame:
    """One row for each run of a resource's detections in a recording; durations: resource_id, duration (frames)."""
    gap = F.when(F.col("duration") > 0, F.least(F.lit(m.gap * fps), F.col("duration") / 2)).otherwise(F.lit(m.gap * fps))
    rows = found.join(durations, "resource_id", "left").withColumn("gap", gap)
    w = Window.partitionBy("recording", "resource_id").orderBy("start", "stop", "ref_start", "ref_stop")
    new = F.coalesce((F.col("start") - F.lag("stop").over(w) > F.col("gap")).cast("int"), F.lit(0))
    marked = rows.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("recording", "resource_id", "cluster").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("ref_start").alias("ref_start"), F.max("ref_stop").alias("ref_stop"), F.sum("score").alias("score"), F.count("*").alias("hits"), F.first("gap").alias("gap"), F.first("duration").alias("duration"), F.sum("share").alias("share_sum"), F.max("share").alias("best_share"), F.sum("time_factor").alias("factor_sum"))


def probes(rows: DataFrame, m: Monitoring, fps: float) -> DataFrame:
    """Windows that look beyond both ends of each occurrence, three for each end that may lie further out."""
    near, back, long_ = m.refine_from * fps, 5 * fps, m.probe * fps
    first = F.greatest(F.lit(0.0), F.col("start") - F.col("gap"))
    begin = F.greatest(F.col("start") - F.col("ref_start"), first)
    room = F.least(F.when(F.col("duration") > 0, F.col("duration") - F.col("ref_stop")).otherwise(F.lit(long_)), F.col("gap"))
    end = F.col("stop") + room
    left = [F.col("start") - long_, (F.col("start") + begin) / 2 - back, begin - back]
    right = [F.col("stop") - back, (F.col("stop") + end) / 2 - long_ / 2, end - long_ + back]
    at = lambda x: F.floor(F.greatest(F.lit(0.0), x)).cast("long")
    side = lambda name, offsets, if_: F.when(if_, F.array(*(F.struct(F.lit(f"{name}{k}").alias("probe"), at(x).alias("at")) for k, x in enumerate(offsets)))).otherwise(F.array().cast("array<struct<probe:string,at:bigint>>"))
    all_ = F.concat(side("l", left, F.col("ref_start") >= near), side("r", right, room >= near))
    out = rows.select("recording", "resource_id", "cluster", F.explode(all_).alias("p")).select("recording", "resource_id", "cluster", "p.*", F.lit(int(long_)).alias("frames"))
    return out.withColumn("query_id", F.concat_ws("/", "recording", "resource_id", "cluster", "probe"))


def refined(rows: DataFrame, looked: DataFrame, seen: DataFrame) -> DataFrame:
    """rows with both ends moved to the furthest that their probes (looked) found (seen) within the gap."""
    met = seen.select("query_id", F.col("start").alias("s"), F.col("stop").alias("e"), F.col("ref_start").alias("rs"), F.col("ref_stop").alias("re")).join(looked.select("query_id", "recording", "resource_id", "cluster", "probe"), "query_id").join(rows.select("recording", "resource_id", "cluster", "start", "stop", "gap"), ["recording", "resource_id", "cluster"])
    left = F.col("probe").startswith("l") & (F.col("s") < F.col("start")) & (F.col("s") >= F.greatest(F.lit(0.0), F.col("start") - F.col("gap")))
    right = F.col("probe").startswith("r") & (F.col("e") > F.col("stop")) & (F.col("e") <= F.col("stop") + F.col("gap"))
    best = met.groupBy("recording", "resource_id", "cluster").agg(F.min(F.when(left, F.struct("s", "probe", "rs"))).alias("l"), F.max(F.when(right, F.struct(F.col("e"), (-F.ascii(F.substring("probe", 2, 1))).alias("o"), F.col("re")))).alias("r"))
    out = rows.join(best, ["recording", "resource_id", "cluster"], "left")
    return out.withColumns({"start": F.coalesce("l.s", "start"), "ref_start": F.coalesce("l.rs", "ref_start"), "stop": F.coalesce("r.e", "stop"), "ref_stop": F.coalesce("r.re", "ref_stop")}).drop("l", "r")


def monitor(prints: DataFrame, recordings: DataFrame, index, durations: DataFrame, match: Matching, m: Monitoring = Monitoring(), avoid: DataFrame | None = None) -> DataFrame:
    """Occurrences of resources in recordings: two passes, merged, in clusters, with refined ends.

    prints: recording, hash, t1; recordings: recording, total; durations: resource_id, duration; all in
    frames. avoid: recording and resource_id that don't count. Each pass is a table, as later steps read it more than once.
    """
    fps = 1 / match.seconds_per_frame
    first = written(detect(prints, coarse_windows(recordings, m, fps), index, match, avoid=avoid).drop("query_id"), "pass")
    second = detect(prints, fine_windows(first, recordings, m, fps), index, match, avoid=avoid).drop("query_id")
    rows = written(occurrences(merged(first, second, int(m.slack * fps)), durations, m, fps), "occurrences")
    looked = written(probes(rows, m, fps), "probes")
    seen = detect(prints, looked.select("query_id", "recording", "at", "frames"), index, match, looked.select("query_id", "resource_id"))
    return refined(rows, looked, seen)


def tracks_of(rows: DataFrame, m: Monitoring, seconds_per_frame: float) -> DataFrame:
    """One accepted row for each recording and resource: the envelope of its occurrences, and these in order."""
    s = seconds_per_frame
    one = F.struct(*((F.col(c) * s).alias(c) for c in ("start", "stop", "ref_start", "ref_stop")), "score", "hits")
    out = rows.groupBy("recording", "resource_id").agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.min("ref_start").alias("c"), F.max("ref_stop").alias("d"), F.sum("score").alias("score"), F.sum("hits").alias("hits"), F.sum("share_sum").alias("share"), F.max("best_share").alias("best_share"), F.sum("factor_sum").alias("factor"), F.sort_array(F.collect_list(one)).alias("windows"))
    out = out.where(accepted(F.col("score"), F.col("best_share"), m.min_score, m.min_share))
    return out.select("recording", "resource_id", (F.col("a") * s).alias("query_start"), (F.col("b") * s).alias("query_stop"), (F.col("c") * s).alias("ref_start"), (F.col("d") * s).alias("ref_stop"), "score", "hits", (F.col("share") / F.col("hits")).alias("mean_share"), "best_share", (F.col("factor") / F.col("hits")).alias("time_factor"), "windows")


def long_windows(recordings: DataFrame, fps: float, length: int = 30) -> DataFrame:
    """recordings: recording, total (frames). Sample windows over a whole recording and one at its very end, numbered."""
    size, stride = int(length * fps), int((length - 1) * fps)
    last = F.greatest(F.col("total") - size, F.lit(0))
    at = F.concat(F.when(last > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(greatest(total - {size}, 0) - 1) div {stride}")), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>")), F.array(last.cast("long")))
    rows = recordings.where("total > 0").select("recording", F.posexplode(at).alias("win", "at"), F.size(at).alias("wins"))
    return rows.withColumns({"frames": F.lit(size), "query_id": F.concat_ws("/", "recording", "at")})


def whole_copies(prints: DataFrame, recordings: DataFrame, index, match: Matching, length: int = 30, slack: float = 2.0, least: float = 0.99, avoid: DataFrame | None = None) -> DataFrame:
    """(recording, resource_id, score) of resources that match every sample window of a recording at one alignment."""
    fps = 1 / match.seconds_per_frame
    windows = written(long_windows(recordings, fps, length), "windows")
    found = detect(prints, windows.drop("win", "wins"), index, match, avoid=avoid).join(windows.select("query_id", "win", "wins"), "query_id")
    good = gates.quality(F.col("score"), F.col("share")) & gates.density(F.col("score"), F.lit(length)) & (F.col("share") >= least) & (F.col("stop") - F.col("start") >= int((length - 2) * fps))
    rows = found.where(good).withColumn("shift", F.col("ref_start") - F.col("start"))
    base = F.min(F.when(F.col("win") == 0, F.col("shift"))).over(Window.partitionBy("recording", "resource_id"))
    ok = rows.withColumn("_b", base).where(F.abs(F.col("shift") - F.col("_b")) <= int(slack * fps))
    return ok.groupBy("recording", "resource_id", "wins").agg(F.countDistinct("win").alias("n"), F.max(F.when(F.col("win") == F.col("wins") - 1, F.col("score"))).alias("score")).where("n = wins").select("recording", "resource_id", "score")


def streaks(rows: DataFrame, flag: Column, key: str, order: str, least: int = 5) -> DataFrame:
    """Runs of at least so many consecutive rows with the flag."""
    w = Window.partitionBy(key).orderBy(order)
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "_f").orderBy(order))
    return rows.withColumn("_f", flag).withColumn("run", run).where("_f").groupBy(key, "run").agg(F.count("*").alias("length"), F.min(order).alias("first")).where(F.col("length") >= least).drop("run")
