"""Logarithmic bands and pitch of sound, in chunks of samples.

Bands: a kernel for each band, as long as tells it from its neighbours, is transformed once; its spectrum
is nearly empty, so one transform of a block gives all bands by a sparse product. Pitch: the difference
function of a frame by autocorrelation, its cumulative mean, and a parabola through the first dip.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakfold.config import Extraction
from peakfold.operators import extract, pack
from peakfold.session import ship_package


@dataclass(frozen=True)
class Bands:
    """Lowest and highest frequency, bands an octave, rate, samples between blocks, the least weight of a kernel's bin that counts."""

    lowest: float = 110.0
    highest: float = 7040.0
    octave: int = 85
    rate: int = 16000
    step: int = 128
    least: float = 0.005

    @property
    def count(self) -> int:
        return int(round(self.octave * math.log2(self.highest / self.lowest)))

    @property
    def quality(self) -> float:
        return 1 / (2 ** (1 / self.octave) - 1)

    @property
    def size(self) -> int:
        """A block's samples: the longest kernel's, up to a power of two."""
        return 1 << math.ceil(math.log2(math.ceil(self.quality * self.rate / self.lowest)))

    @property
    def latency(self) -> float:
        """Seconds from a block's first sample to the middle of its kernels."""
        return self.size / 2 / self.rate

    def hz(self) -> np.ndarray:
        return self.lowest * 2.0 ** (np.arange(self.count) / self.octave)


@cache
def kernels(b: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each band, bin, weight): the spectral kernels without what is negligible. Kernels are in the block's middle."""
    starts, bins, weights = [], [], []
    n = 0
    for hz in b.hz():
        length = int(math.ceil(b.quality * b.rate / hz))
        at = np.arange(length)
        window = np.hanning(length + 1)[:length] if length > 1 else np.ones(1)
        kernel = np.zeros(b.size, np.complex128)
        first = (b.size - length) // 2
        kernel[first : first + length] = window / window.sum() * np.exp(2j * np.pi * hz * at / b.rate)
        spectrum = np.conj(np.fft.fft(kernel)) / b.size
        some = np.flatnonzero(np.abs(spectrum) > b.least * np.abs(spectrum).max())
        some = some[some <= b.size // 2]  # what is real has the rest there already
        starts.append(n)
        bins.append(some)
        weights.append(spectrum[some])
        n += len(some)
    return np.array(starts), np.concatenate(bins), np.concatenate(weights)


def bands_of(frames: np.ndarray, b: Bands) -> np.ndarray:
    """Magnitude of each band in each block: one transform, then each band's few bins, weighted and summed."""
    starts, bins, weights = kernels(b)
    out = np.empty((len(frames), b.count), np.float64)
    for first in range(0, len(frames), 64):
        z = np.fft.rfft(frames[first : first + 64].astype(np.float64), axis=1)
        out[first : first + 64] = np.abs(np.add.reduceat(z[:, bins] * weights, starts, axis=1))
    return out


def _settings(b: Bands) -> Extraction:
    return Extraction(sample_rate=b.rate, size=b.size, step=b.step, min_bin=0)


def _sound(chunks: DataFrame, e: Extraction, give, schema: pa.Schema, ddl: str) -> DataFrame:
    """Per chunk: give(row, frames) as a batch."""
    of_files = "raw" in chunks.columns

    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("raw", "samples")]
            for row, content in zip(batch.select(names).to_pylist(), batch.column("raw" if of_files else "samples"), strict=True):
                out = give(row, extract.frames_of(extract.samples_in(row, content, e), e.size, e.step))
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([np.full(len(out[0]), row["resource_id"]), *out], schema.types, strict=True)], schema=schema)

    ship_package(chunks.sparkSession)
    return chunks.mapInArrow(run, ddl)


def band_frames(chunks: DataFrame, b: Bands = Bands()) -> DataFrame:
    """(resource_id, t, m): magnitudes of the bands, for the frames of each chunk's core."""
    schema = pa.schema([("resource_id", pa.int64()), ("t", pa.int32()), ("m", pa.list_(pa.float64()))])

    def give(row, frames):
        low, high = row["core_from"] - row["first"], row["core_to"] - row["first"]
        return [np.arange(row["core_from"], row["core_to"], dtype=np.int32), extract._lists(bands_of(frames[low:high], b))]

    return _sound(chunks, _settings(b), give, schema, "resource_id long, t int, m array<double>")


def band_triples(chunks: DataFrame, b: Bands = Bands(), k: extract.Peaks = extract.Peaks(bins=51), e: Extraction | None = None) -> DataFrame:
    """Triples of peaks of the bands that begin in each chunk's core; f1 and so on are bands."""
    e = e or _settings(b)
    schema = extract._TRIPLE

    def give(row, frames):
        bands = bands_of(frames, b)
        at, f = extract.peaks_in(bands, k)
        t, m = at + row["first"], bands[at, f]
        parts = list(extract.triples_in(t, f, (t >= row["core_from"]) & (t < row["core_to"]), e))
        places = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return [x for p in places for x in (t[p].astype(np.int32), f[p].astype(np.int32), m[p])]

    return _sound(chunks, _settings(b), give, schema, "resource_id long, " + ", ".join(f"t{j} int, f{j} int, m{j} double" for j in (1, 2, 3)))


def tolerant_prints(found: DataFrame) -> DataFrame:
    """hash, resource_id, t1, f1 with hashes of ratios, which stand changes of speed and pitch."""
    return extract.prints(found, pack.ratio_hash())


# Pitch ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Yin:
    """Frame and step in samples, rate, the dip that counts as one, and the range of frequencies."""

    size: int = 2048
    step: int = 1024
    rate: int = 16000
    threshold: float = 0.15
    lowest: float = 50.0
    highest: float = 2000.0


def differences(frames: np.ndarray, most: int) -> np.ndarray:
    """Sum of squared differences of each frame's first half and itself a lag later, for lags up to ``most``.

    It is the energy of both less twice their product, which a transform gives for all lags at once.
    """
    half = frames.shape[1] // 2
    x = frames.astype(np.float64)
    room = 1 << math.ceil(math.log2(frames.shape[1] + half))
    product = np.fft.irfft(np.fft.rfft(x, room, axis=1) * np.conj(np.fft.rfft(x[:, :half], room, axis=1)), room, axis=1)[:, : most + 1]
    energy = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)
    lags = np.arange(most + 1)
    return np.maximum(energy[:, half : half + 1] + energy[:, lags + half] - energy[:, lags] - 2 * product, 0)


#: Samples; several periods that are shorter are measured together, as a parabola is a coarse fit to a narrow dip.
LONG = 80


def pitches_of(frames: np.ndarray, y: Yin = Yin()) -> np.ndarray:
    """The pitch of each frame in Hz, NaN where there is none: the first dip of the normalised differences below
    the threshold, followed to its bottom, between samples by a parabola."""
    most = min(frames.shape[1] // 2 - 1, int(y.rate / y.lowest) + 1)
    least = max(2, int(y.rate / y.highest))
    out = np.full(len(frames), np.nan)
    if not len(frames) or most <= least + 1:
        return out
    d = differences(frames, most)
    mean = np.cumsum(d[:, 1:], axis=1)
    norm = np.ones_like(d)
    np.divide(d[:, 1:] * np.arange(1, most + 1), mean, out=norm[:, 1:], where=mean > 0)
    below = norm[:, least:most] < y.threshold
    first = below.argmax(axis=1)
    rising = norm[:, least + 1 : most + 1] >= norm[:, least:most]
    rising &= np.arange(most - least)[None, :] >= first[:, None]
    lag = rising.argmax(axis=1) + least
    ok = np.flatnonzero(below.any(axis=1) & rising.any(axis=1) & (lag < most))
    period = _bottom(d, ok, lag[ok])
    times = np.maximum(1, np.minimum(LONG / period, (most - 2) / period).astype(np.int64))
    many = times > 1  # of one period the bottom is known; half a sample further there may be no difference to look at
    whole = period.copy()
    whole[many] = _bottom(d, ok[many], np.round(times[many] * period[many]).astype(np.int64))
    out[ok] = y.rate * times / whole
    return out


def _bottom(d: np.ndarray, rows: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Where the parabola through a lag's differences and its neighbours' is least."""
    a, b, c = (d[rows, lag + k] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    return lag + np.clip(np.divide(a - c, 2 * bend, out=np.zeros(len(rows)), where=bend > 0), -1, 1)


def pitches(chunks: DataFrame, y: Yin = Yin()) -> DataFrame:
    """(resource_id, t, hz) of the frames of each chunk's core that have a pitch; chunks are made with settings_of(y)."""
    schema = pa.schema([("resource_id", pa.int64()), ("t", pa.int32()), ("hz", pa.float64())])

    def give(row, frames):
        low, high = row["core_from"] - row["first"], row["core_to"] - row["first"]
        hz = pitches_of(frames[low:high], y)
        at = np.flatnonzero(~np.isnan(hz))
        return [(at + row["core_from"]).astype(np.int32), hz[at]]

    return _sound(chunks, settings_of(y), give, schema, "resource_id long, t int, hz double")


def settings_of(y: Yin) -> Extraction:
    return Extraction(sample_rate=y.rate, size=y.size, step=y.step, min_bin=0)


def settings_of_bands(b: Bands = Bands()) -> Extraction:
    return _settings(b)


def seconds(t: Column, b: Bands = Bands()) -> Column:
    """A block's time: that of its kernels' middle."""
    return t * b.step / F.lit(float(b.rate)) + b.latency
