"""From sound to prints, in chunks of samples: any part of a long recording is a row of its own.

A chunk has a core of frames and as many more on both sides as peaks and prints of the core can depend on.
Each point and print belongs to the chunk whose core has its (first) frame, so what a task gives doesn't
depend on how a recording was cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.config import Extraction
from peakfold.functions.sliding import over_ranges, sliding
from peakfold.operators import pack
from peakfold.session import ship_package
from peakfold.sources.audio import form_of, mono

#: Bytes of a file in which its sound has to begin.
HEAD = 1 << 20


@dataclass(frozen=True)
class Peaks:
    """Neighbourhood of a peak: bins to both sides, frames before and after. Frames of a chunk's core."""

    bins: int = 10
    before: int = 12
    after: int = 11
    core: int = 2500


# Frames as arrays -------------------------------------------------------------------------------------


def frames_of(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """Overlapping frames of the samples, the last one padded."""
    n = max(0, -(-(len(x) - size) // step)) + 1 if len(x) else 0
    y = np.zeros(max(0, n - 1) * step + size if n else 0, np.float32)
    y[: len(x)] = x[: len(y)]
    return np.lib.stride_tricks.sliding_window_view(y, size)[::step] if n else np.zeros((0, size), np.float32)


def without_impulses(frames: np.ndarray, most: float = 1 / 32767) -> np.ndarray:
    """Frames whose one nonzero sample is an isolated quantisation step become silent."""
    lone = (frames != 0).sum(axis=1) == 1
    lone &= ~(np.abs(frames).max(axis=1, initial=0) > np.float32(most)) & ~np.isnan(frames).any(axis=1)
    return np.where(lone[:, None], np.float32(0), frames)


def power(frames: np.ndarray, e: Extraction) -> np.ndarray:
    """Squared magnitudes of each frame's bins; those below the least one are missing, so column 0 is bin min_bin."""
    z = np.fft.rfft(frames.astype(np.float64), axis=1)[:, e.min_bin : frames.shape[1] // 2]
    return z.real**2 + z.imag**2


def peaks_in(m: np.ndarray, k: Peaks = Peaks()) -> tuple[np.ndarray, np.ndarray]:
    """(frame, column) of the cells that are the largest of their neighbourhood, where that is whole in time."""
    if not m.size or len(m) < k.before + k.after + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    vertical = sliding(m, k.bins, k.bins, 1)
    best = (m == vertical) & (m == sliding(vertical, k.before, k.after, 0)) & (m != 0)
    best[: k.before] = best[len(m) - k.after :] = False
    return np.nonzero(best)


def _followers(t: np.ndarray, f: np.ndarray, of: np.ndarray, e: Extraction) -> tuple[np.ndarray, np.ndarray]:
    """(place in of, point) for the points that may follow each point of ``of``; points stand in order of time."""
    low, high = e.time_distance
    a, b = np.searchsorted(t, t[of] + low), np.searchsorted(t, t[of] + high, "right")
    n = b - a
    left = np.repeat(np.arange(len(of)), n)
    right = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
    gap = np.abs(f[right] - f[of[left]])
    ok = (gap >= e.freq_distance[0]) & (gap <= e.freq_distance[1])
    return left[ok], right[ok]


def triples_in(t: np.ndarray, f: np.ndarray, first: np.ndarray, e: Extraction, at_once: int = 200_000):
    """Triples of points whose first one is marked, some at a time: three arrays of places."""
    start = np.flatnonzero(first)
    ends = np.searchsorted(t, t[start] + e.time_distance[1], "right") - np.searchsorted(t, t[start] + e.time_distance[0])
    part = np.cumsum(ends.astype(np.int64) ** 2) // at_once
    for some in np.split(start, np.flatnonzero(np.diff(part)) + 1) if len(start) else ():
        left, second = _followers(t, f, some, e)
        one = some[left]
        left, third = _followers(t, f, second, e)
        yield one[left], second[left], third


# Operators on tables of frames ------------------------------------------------------------------------


def _by_length(batch: pa.RecordBatch, column: str):
    """(rows, their arrays as a matrix) for each length that occurs in a batch."""
    values = batch.column(column)
    lens = np.asarray(values.value_lengths().fill_null(0))
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.float64).reshape(len(rows), n)


def _lists(m: np.ndarray) -> pa.Array:
    flat = pa.array(m.ravel(), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32), flat)


def _mapped(frames: DataFrame, give: Callable[[np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """frames: resource_id, t, m. Adds arrays as long as m that follow from m alone, a batch of frames at a time."""

    def run(batches):
        for batch in batches:
            for rows, m in _by_length(batch, "m") if batch.num_rows else ():
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("resource_id").take(at), batch.column("t").take(at), _lists(m), *map(_lists, give(m))], names=["resource_id", "t", "m", *names])

    ship_package(frames.sparkSession)
    schema = "resource_id long, t int, m array<double>, " + ", ".join(f"{n} array<double>" for n in names)
    return frames.select("resource_id", F.col("t").cast("int").alias("t"), F.col("m").cast("array<double>").alias("m")).mapInArrow(run, schema)


def vertical_max(frames: DataFrame, before: int, after: int) -> DataFrame:
    """Adds vmax, the largest magnitudes of neighbouring bins of each frame."""
    return _mapped(frames, lambda m: [sliding(m, before, after)], ["vmax"])


def min_and_max(frames: DataFrame, before: int, after: int) -> DataFrame:
    """Adds vmin and vmax, of neighbouring bins; edges are clamped."""
    return _mapped(frames, lambda m: [sliding(m, before, after, largest=False), sliding(m, before, after)], ["vmin", "vmax"])


def range_max(frames: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """Adds vmax, the largest magnitude of each bin's own range (bin, first, one past the last); null without one."""
    f, a, b = (np.array(x) for x in zip(*ranges, strict=True))

    def give(m: np.ndarray) -> list[np.ndarray]:
        out = np.full(m.shape, np.nan)
        inside = f < m.shape[1]
        out[:, f[inside]] = over_ranges(m, np.minimum(a, m.shape[1])[inside], b[inside])
        return [out]

    return _mapped(frames, give, ["vmax"])


def cells(frames: DataFrame, *arrays: str) -> DataFrame:
    """A row a bin: resource_id, t, f and the arrays' elements under their names."""
    return frames.select("resource_id", "t", F.posexplode(F.arrays_zip(*arrays)).alias("f", "x")).select("resource_id", "t", "f", *(F.col(f"x.{a}").alias(a) for a in arrays))


def _in_chunks(frames: DataFrame, before: int, after: int, core: int) -> DataFrame:
    """Each frame in the chunks that need it."""
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - after) / core)).cast("int"), F.expr(f"(t + {before}) div {core}").cast("int"))
    return frames.withColumn("chunk", F.explode(near))


def _chunk_matrix(rows: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(resource, chunk, times in order, magnitudes) of a group."""
    rows = rows.sort_by("t").combine_chunks()
    m = rows.column("m").chunk(0)
    return rows.column("resource_id")[0].as_py(), rows.column("chunk")[0].as_py(), rows.column("t").to_numpy(), m.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)


def horizontal_max(frames: DataFrame, before: int = 12, after: int = 11, core: int = 1024) -> DataFrame:
    """frames: resource_id, t without gaps, m of one length. Adds hmax, the largest of neighbouring frames in each bin."""
    schema = pa.schema([("resource_id", pa.int64()), ("t", pa.int32()), ("m", pa.list_(pa.float64())), ("hmax", pa.list_(pa.float64()))])

    def run(rows: pa.Table) -> pa.Table:
        key, chunk, t, m = _chunk_matrix(rows)
        mine = t // core == chunk
        return pa.Table.from_arrays([pa.array([key] * int(mine.sum()), pa.int64()), pa.array(t[mine], pa.int32()), _lists(m[mine]), _lists(sliding(m, before, after, 0)[mine])], schema=schema)

    ship_package(frames.sparkSession)
    rows = _in_chunks(frames.select("resource_id", F.col("t").cast("int").alias("t"), F.col("m").cast("array<double>").alias("m")), before, after, core)
    return rows.groupBy("resource_id", "chunk").applyInArrow(run, "resource_id long, t int, m array<double>, hmax array<double>")


def event_points(frames: DataFrame, k: Peaks = Peaks(core=1024)) -> DataFrame:
    """frames: resource_id, t without gaps, m of one length. (resource_id, t, f, m) of the cells that are the largest
    of their neighbourhood; frames near the ends, where it isn't whole, have none. A resource is as many groups as it has chunks."""
    schema = pa.schema([("resource_id", pa.int64()), ("t", pa.int32()), ("f", pa.int32()), ("m", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        key, chunk, t, m = _chunk_matrix(rows)
        at, f = peaks_in(m, k)
        mine = t[at] // k.core == chunk
        at, f = at[mine], f[mine]
        return pa.Table.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(t[at], pa.int32()), pa.array(f, pa.int32()), pa.array(m[at, f])], schema=schema)

    ship_package(frames.sparkSession)
    rows = _in_chunks(frames.select("resource_id", F.col("t").cast("int").alias("t"), F.col("m").cast("array<double>").alias("m")), k.before, k.after, k.core)
    return rows.groupBy("resource_id", "chunk").applyInArrow(run, "resource_id long, t int, f int, m double")


# Sound ------------------------------------------------------------------------------------------------


def frame_count(samples: Column, e: Extraction) -> Column:
    return F.when(samples > 0, F.greatest(F.lit(0), F.ceil((samples - e.size) / e.step)) + 1).otherwise(F.lit(0)).cast("long")


def _with_chunks(rows: DataFrame, total: str, e: Extraction, k: Peaks) -> DataFrame:
    """Explodes each recording into its chunks: first (frame), core_from, core_to (frames), from and to (samples)."""
    more = k.after + 2 * e.time_distance[1]
    rows = rows.withColumn("frames", frame_count(F.col(total), e)).where("frames > 0")
    rows = rows.withColumn("chunk", F.explode(F.expr(f"sequence(0, (frames - 1) div {k.core})")))
    rows = rows.withColumns({"core_from": F.col("chunk") * k.core, "core_to": F.least(F.col("frames"), (F.col("chunk") + 1) * k.core)})
    rows = rows.withColumns({"first": F.greatest(F.lit(0), F.col("core_from") - k.before), "_last": F.least(F.col("frames"), F.col("core_to") + more)})
    return rows.withColumns({"from": F.col("first") * e.step, "to": F.least(F.col(total), (F.col("_last") - 1) * e.step + e.size)}).drop("_last", "frames")


def _form(spark: SparkSession) -> Callable[[Column], Column]:
    """A WAV file's form from its head, or what is wrong with it."""
    def of(heads: pd.Series) -> pd.DataFrame:
        out = []
        for raw in heads:
            try:
                out.append((*form_of(bytes(raw or b"")), None))
            except ValueError as error:
                out.append((0, 0, 0, 0, 0, str(error)))
        return pd.DataFrame(out, columns=["rate", "channels", "bits", "at", "size", "error"])

    ship_package(spark)
    return F.pandas_udf(of, "rate long, channels int, bits int, at long, size long, error string")


def sound_files(files: DataFrame, e: Extraction = Extraction()) -> DataFrame:
    """files: resource_id, content (WAV bytes). Adds form (rate, channels, bits, at, size), samples at the rate of
    the settings, seconds, and error: null, or why a file can't be read."""
    form = _form(files.sparkSession)(F.substring("content", 1, HEAD))
    rows = files.select("resource_id", "content", form.alias("form"))
    size = F.least(F.col("form.size"), F.length("content") - F.col("form.at"))
    own = F.when(F.col("form.error").isNull(), F.expr("greatest(0L, size) div (form.channels * form.bits div 8)")).otherwise(F.lit(0))
    rows = rows.withColumn("size", size).withColumn("own", own.cast("long")).drop("size")
    samples = F.when(F.col("form.rate") == e.sample_rate, F.col("own")).otherwise(F.expr(f"cast(own * {e.sample_rate} / nullif(form.rate, 0) as bigint)"))
    return rows.withColumns({"samples": F.coalesce(samples, F.lit(0)), "seconds": F.coalesce(F.try_divide(F.col("own"), F.col("form.rate")), F.lit(0.0)), "error": F.col("form.error")})


def chunks_of_files(sound: DataFrame, e: Extraction = Extraction(), k: Peaks = Peaks()) -> DataFrame:
    """sound: sound_files(). A row a chunk with the bytes of its own samples alone, dealt over all tasks."""
    rows = _with_chunks(sound.where("error is null"), "samples", e, k)
    low = F.expr(f"`from` * form.rate div {e.sample_rate}")
    high = F.least(F.col("own"), F.expr(f"(`to` - 1) * form.rate div {e.sample_rate} + 2"))
    width = F.expr("form.channels * form.bits div 8")
    rows = rows.withColumns({"low": low.cast("long"), "high": high.cast("long")})
    raw = F.substring("content", (F.col("form.at") + F.col("low") * width + 1).cast("int"), ((F.col("high") - F.col("low")) * width).cast("int"))
    out = rows.select("resource_id", "chunk", "first", "core_from", "core_to", "from", "to", "low", "form.rate", "form.channels", "form.bits", raw.alias("raw"))
    return out.repartition("resource_id", "chunk")


def chunks_of_pieces(pieces: DataFrame, e: Extraction, k: Peaks) -> DataFrame:
    """pieces: resource_id, at (the place of the first sample), samples (arrays end to end). A row a chunk with its own samples."""
    total = pieces.groupBy("resource_id").agg(F.max(F.col("at") + F.size("samples")).alias("total"))
    spans = _with_chunks(total, "total", e, k).drop("total")
    width = k.core * e.step  # a piece is in the chunks that are about as far, of which there are few
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.expr(f"at div {width} - 1")), F.expr(f"(at + size(samples)) div {width} + 1"))
    if width < (k.after + 2 * e.time_distance[1] + k.before) * e.step + e.size:
        more = 2 + ((k.after + 2 * e.time_distance[1] + k.before) * e.step + e.size) // width
        near = F.sequence(F.greatest(F.lit(0).cast("long"), F.expr(f"at div {width} - {more}")), F.expr(f"(at + size(samples)) div {width} + {more}"))
    met = pieces.withColumn("chunk", F.explode(near)).join(spans, ["resource_id", "chunk"]).where("at < `to` and at + size(samples) > `from`")
    own = F.struct("at", F.col("samples").cast("array<float>").alias("samples"))
    keys = ["resource_id", "chunk", "first", "core_from", "core_to", "from", "to"]
    rows = met.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("p"))
    cut = F.expr("slice(flatten(transform(p, x -> x.samples)), cast(`from` - p[0].at + 1 as int), cast(`to` - `from` as int))")
    return rows.select(*keys, cut.alias("samples"))


def samples_in(row: dict, content: pa.Scalar, e: Extraction) -> np.ndarray:
    """A chunk's samples at the rate of the settings; content: bytes of a file, or the samples themselves."""
    if "bits" not in row:
        return content.values.to_numpy(zero_copy_only=False).astype(np.float32)
    x = mono(content.as_py(), row["channels"], row["bits"])
    if row["rate"] != e.sample_rate and len(x):
        at = np.arange(row["from"], row["to"]) * row["rate"] / e.sample_rate - row["low"]
        x = np.interp(at, np.arange(len(x)), x).astype(np.float32)
    return x


_TRIPLE = pa.schema([("resource_id", pa.int64()), *((f"{c}{k}", pa.float64() if c == "m" else pa.int32()) for k in (1, 2, 3) for c in "tfm")])


def triples(chunks: DataFrame, e: Extraction = Extraction(), k: Peaks = Peaks()) -> DataFrame:
    """chunks: of files or of pieces. resource_id, t1, f1, m1 to t3, f3, m3 of the triples that begin in each chunk's core."""
    of_files = "raw" in chunks.columns

    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("raw", "samples")]
            for row, content in zip(batch.select(names).to_pylist(), batch.column("raw" if of_files else "samples"), strict=True):
                x = samples_in(row, content, e)
                m = power(without_impulses(frames_of(x, e.size, e.step)), e)
                at, f = peaks_in(m, k)
                t = at + row["first"]
                for places in triples_in(t, f + e.min_bin, (t >= row["core_from"]) & (t < row["core_to"]), e):
                    if len(places[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places[0]), row["resource_id"])), *(a for p in places for a in (pa.array(t[p].astype(np.int32)), pa.array((f[p] + e.min_bin).astype(np.int32)), pa.array(m[at[p], f[p]])))], schema=_TRIPLE)

    ship_package(chunks.sparkSession)
    return chunks.mapInArrow(run, "resource_id long, " + ", ".join(f"t{k} int, f{k} int, m{k} double" for k in (1, 2, 3)))


def prints(found: DataFrame, hash_: Column | None = None) -> DataFrame:
    """hash, resource_id, t1, f1 of triples; the hash with durations, or another one."""
    return found.select((pack.duration_hash() if hash_ is None else hash_).alias("hash"), "resource_id", "t1", "f1").distinct()
