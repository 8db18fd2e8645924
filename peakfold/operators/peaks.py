"""Spectral peaks: local maxima over a neighbourhood in time and frequency."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.config import Extraction
from peakfold.session import ship_package


def suppress_impulse(samples: Column, most: float = 1 / 32767) -> Column:
    """Zeroes a frame whose one nonzero sample is an isolated quantisation step."""
    some = F.filter(samples, lambda x: x != 0)
    one = (F.size(some) == 1) & (F.abs(F.get(some, F.lit(0))) <= F.lit(most).cast("float")) & ~F.isnan(F.get(some, F.lit(0)))
    return F.when(one, F.transform(samples, lambda x: F.lit(0).cast("float"))).otherwise(samples)


def vertical_max(spectrum: DataFrame, before: int, after: int) -> DataFrame:
    """Adds vmax, the largest magnitude of neighbouring bins of the same frame."""
    return spectrum.withColumn("vmax", F.max("m").over(Window.partitionBy("resource_id", "t").orderBy("f").rowsBetween(-before, after)))


def event_points(spectrum: DataFrame, bins: int = 10, before: int = 12, after: int = 11) -> DataFrame:
    """spectrum: resource_id, t, f, m. Points that are the maximum of their neighbourhood; frames near the ends, where it isn't whole, have none."""
    v = vertical_max(spectrum, bins, bins)
    w = Window.partitionBy("resource_id", "f").orderBy("t")
    near = w.rowsBetween(-before, after)
    h = v.withColumns({"hmax": F.max("vmax").over(near), "frames": F.count("*").over(near)})
    return h.where((F.col("frames") == before + after + 1) & (F.col("m") == F.col("vmax")) & (F.col("m") == F.col("hmax")) & (F.col("m") != 0)).select("resource_id", "t", "f", "m")


def neighbour_sum(spectrum: DataFrame) -> DataFrame:
    """Adds the sum of magnitudes of the 3 x 3 cells around each; missing cells count as nothing."""
    by_f = Window.partitionBy("resource_id", "t").orderBy("f").rowsBetween(-1, 1)
    by_t = Window.partitionBy("resource_id", "f").orderBy("t").rowsBetween(-1, 1)
    return spectrum.withColumn("_r", F.sum("m").over(by_f)).withColumn("around", F.sum("_r").over(by_t)).drop("_r")


def midi_key(hz: float) -> int:
    """The nearest key to a frequency."""
    return int(math.floor(69 + 12 * math.log2(hz / 440) + 0.5))


def _search(keys: list[int], key: int) -> int:
    """Where a key is found by halving, or -(insertion point) - 1. Keys repeat, so which of equals is found
    follows from the halving; the ranges depend on it."""
    low, high = 0, len(keys) - 1
    while low <= high:
        middle = (low + high) // 2
        if keys[middle] < key:
            low = middle + 1
        elif keys[middle] > key:
            high = middle - 1
        else:
            return middle
    return -(low + 1)


def key_ranges(e: Extraction = Extraction(), keys: int = 20) -> list[tuple[int, int, int]]:
    """(bin, first, one past the last) of the bins whose keys are within half of ``keys`` around each bin's key.

    Bins below the least one have key 0. The last key is searched as it is; where it isn't there, the place
    after its insertion point ends the range.
    """
    n, width = e.size // 2, e.sample_rate / e.size
    key = [0] * e.min_bin + [midi_key(f * width + width / 2) for f in range(e.min_bin, n)]
    out = []
    for f in range(e.min_bin, n):
        first = _search(key, key[f] - keys // 2)
        first = first if first >= 0 else -first - 1
        out.append((f, max(e.min_bin, first), min(abs(_search(key, key[f] + keys // 2)), n)))
    return out


def range_max(spectrum: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """Adds vmax over each bin's own range; bins without one go. A frame's magnitudes are one array, of which
    each bin takes its slice, so no rows are multiplied; ranges are a table of some hundred entries."""
    of = F.create_map(*(F.lit(x) for f, a, b in ranges for x in (f, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
    frames = spectrum.groupBy("resource_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("f", "m"))).alias("by"))
    m = frames.select("resource_id", "t", "by", F.explode(F.map_keys("by")).alias("f")).withColumn("r", F.element_at(of, F.col("f"))).where("r is not null")
    inside = F.filter(F.transform(F.sequence(F.col("r.a"), F.greatest(F.col("r.a"), F.col("r.b") - 1)), lambda k: F.when(k < F.col("r.b"), F.element_at("by", k))), lambda x: x.isNotNull())
    return m.select("resource_id", "t", "f", F.element_at("by", F.col("f")).alias("m"), F.array_max(inside).alias("vmax"))


def min_and_max(spectrum: DataFrame, before: int, after: int) -> DataFrame:
    """Adds the least and the largest magnitude of neighbouring bins of the same frame; edges are clamped."""
    w = Window.partitionBy("resource_id", "t").orderBy("f").rowsBetween(-before, after)
    return spectrum.withColumns({"vmin": F.min("m").over(w), "vmax": F.max("m").over(w)})


def power_spectrum(frames: DataFrame, e: Extraction = Extraction()) -> DataFrame:
    """frames: resource_id, t, samples. (resource_id, t, f, m): squared magnitudes of each frame's bins from the
    least one on. A transform has no column form, so whole batches of frames are transformed at once."""

    def run(batches):
        for batch in batches:
            ids, at = (np.asarray(batch.column(c)) for c in ("resource_id", "t"))
            for n in sorted({len(x) for x in batch.column("samples")} if batch.num_rows else ()):
                rows = [k for k, x in enumerate(batch.column("samples")) if len(x) == n]
                if n < 2:
                    continue
                samples = np.array([batch.column("samples")[k].as_py() for k in rows], np.float64)
                z = np.fft.rfft(samples, axis=1)[:, : n // 2]
                m = (z.real**2 + z.imag**2)[:, e.min_bin :]
                bins = m.shape[1]
                if bins:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], bins)), pa.array(np.repeat(at[rows], bins).astype(np.int32)), pa.array(np.tile(np.arange(e.min_bin, e.min_bin + bins, dtype=np.int32), len(rows))), pa.array(m.ravel())], names=["resource_id", "t", "f", "m"])

    ship_package(frames.sparkSession)
    return frames.select("resource_id", F.col("t").cast("int").alias("t"), F.col("samples").cast("array<float>").alias("samples")).mapInArrow(run, "resource_id long, t int, f int, m double")


def band_spectrum(frames: DataFrame, lowest: float = 110.0, highest: float = 7040.0, bands: int = 85, rate: int = 16000) -> DataFrame:
    """frames: resource_id, t, samples. (resource_id, t, f, m): magnitudes of logarithmic bands, each measured with a
    window of as many periods as tell it from its neighbours, or the whole frame. An approximation of a
    constant-quality transform, for frames of one length a batch."""
    n = int(round(bands * math.log2(highest / lowest)))
    hz = lowest * 2.0 ** (np.arange(n) / bands)
    quality = 1 / (2 ** (1 / bands) - 1)

    def kernel(size: int) -> np.ndarray:
        at = np.arange(size)[:, None] - size / 2
        width = np.minimum(quality * rate / hz, size)[None, :]
        window = np.where(np.abs(at) <= width / 2, 0.5 + 0.5 * np.cos(2 * np.pi * at / width), 0.0)
        return (window / window.sum(axis=0) * np.exp(-2j * np.pi * hz[None, :] * at / rate)).astype(np.complex64)

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, at = (np.asarray(batch.column(c)) for c in ("resource_id", "t"))
            sizes = [len(x) for x in batch.column("samples")]
            for size in sorted(set(sizes) - {0}):
                rows = [k for k, x in enumerate(sizes) if x == size]
                known = known if size in known else {size: kernel(size)}
                for first in range(0, len(rows), 256):
                    part = rows[first : first + 256]
                    x = np.array([batch.column("samples")[k].as_py() for k in part], np.float32)
                    m = np.abs(x @ known[size]).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], n)), pa.array(np.repeat(at[part], n).astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))), pa.array(m.ravel())], names=["resource_id", "t", "f", "m"])

    ship_package(frames.sparkSession)
    return frames.select("resource_id", F.col("t").cast("int").alias("t"), F.col("samples").cast("array<float>").alias("samples")).mapInArrow(run, "resource_id long, t int, f int, m double")
