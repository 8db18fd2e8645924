"""Sound files as frames, and how long they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakfold.config import Extraction
from peakfold.session import ship_package

#: Kinds of files whose headers don't tell the length reliably; the longest length that is believed.
DECODED_KINDS, LONGEST = ("m4a", "aac", "mp4", "m4b"), 86400.0
#: Seconds of a recording that have waveform peaks; the largest 16-bit sample.
WAVEFORM, FULL = 21600, 32768.0


def form_of(raw: bytes) -> tuple[int, int, int, int, int]:
    """(rate, channels, bits, where the samples begin, how many bytes they have) of a PCM WAV file of 8, 16 or 32
    bits, from its first part; ValueError for any other."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if kind == b"fmt " and at + 24 <= len(raw):
            form = np.frombuffer(raw, "<u2", 8, at + 8)
        elif kind == b"data":
            if form is None or form[0] not in (1, 0xFFFE) or form[7] not in (8, 16, 32) or not form[1] or not (form[2] or form[3]):
                break
            return int(form[2]) | int(form[3]) << 16, int(form[1]), int(form[7]), at + 8, size
        at += 8 + size + size % 2
    raise ValueError("not PCM of 8, 16 or 32 bits")


def mono(data: bytes, channels: int, bits: int) -> np.ndarray:
    """Samples from -1 to 1, the mean of all channels."""
    whole = len(data) - len(data) % (channels * bits // 8)
    x = np.frombuffer(data[:whole], {8: "u1", 16: "<i2", 32: "<i4"}[bits]).astype(np.float32)
    x = (x - 128) / 128 if bits == 8 else x / float(1 << bits - 1)
    return x.reshape(-1, channels).mean(axis=1)


def samples_of(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of a WAV file."""
    rate, channels, bits, at, size = form_of(raw)
    return rate, mono(raw[at : at + size], channels, bits)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(x):
        return x
    return np.interp(np.arange(int(len(x) * to / rate)) * rate / to, np.arange(len(x)), x).astype(np.float32)


def decoded(files: DataFrame, e: Extraction = Extraction()) -> DataFrame:
    """files: resource_id, content (WAV bytes). (resource_id, t, samples): overlapping frames, the last one padded.

    A file that can't be read gives no frame. Decoding has no column form; a batch is decoded at once.
    """

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column("resource_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    rate, x = samples_of(raw.as_py() or b"")
                except ValueError:
                    continue
                x = resampled(x, rate, e.sample_rate)
                n = max(0, -(-(len(x) - e.size) // e.step)) + 1 if len(x) else 0
                for first in range(0, n, 1000):
                    part = [np.pad(y := x[k * e.step : k * e.step + e.size], (0, e.size - len(y))) for k in range(first, min(n, first + 1000))]
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(part).astype(np.float32)), e.size).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), pa.array(range(first, first + len(part)), pa.int32()), flat], names=["resource_id", "t", "samples"])

    ship_package(files.sparkSession)
    return files.select(F.col("resource_id").cast("long").alias("resource_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "resource_id long, t int, samples array<float>")


def duration(header: Column, kind: Column, decoded_seconds: Column) -> Column:
    """The header's length, or the decoded one where the kind of file or the value makes it doubtful."""
    doubtful = F.lower(kind).isin(*DECODED_KINDS) | header.isNull() | F.isnan(header) | (header <= 0) | (header > LONGEST)
    return F.when(doubtful, decoded_seconds).otherwise(header)


def duration_or_decoded(reported: Column, decoded_seconds: Column) -> Column:
    """What a configured command reports as text, or the decoded length where that is no positive number."""
    x = F.trim(reported).try_cast("double")
    return F.when((x > 0) & ~F.isnan(x), x).otherwise(decoded_seconds)


def waveform(samples: DataFrame, second: Column, value: Column, key: str, full: float = FULL) -> DataFrame:
    """(key, second, peak): the largest magnitude of each second, up to six hours."""
    return samples.withColumn("second", second).where((F.col("second") >= 0) & (F.col("second") < WAVEFORM)).groupBy(key, "second").agg((F.max(F.abs(value)) / full).alias("peak"))
