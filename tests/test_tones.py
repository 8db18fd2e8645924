"""Bands and pitch of made tones; a pitch-shifted signal found by the tolerant matcher."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.config import Matching
from peakfold.operators import align, extract, lookup, pitch, tones
from peakfold.strategies import to_hz

B = tones.Bands()


def tone(hz, n, rate=16000):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_each_band_answers_its_own_tone():
    assert B.count == 510 and B.size == 32768 and B.latency == pytest.approx(1.024)
    for band in (0, 1, 85, 170, 300, 509):
        x = np.zeros((1, B.size))
        x[0] = tone(B.hz()[band], B.size)
        m = tones.bands_of(x, B)[0]
        assert m.argmax() == band and m[band] == pytest.approx(0.5, rel=0.02)
        assert all(m[k] < 0.1 for k in range(B.count) if abs(k - band) > 4)


def test_sparse_kernels_equal_dense_ones():
    x = np.random.default_rng(1).normal(size=(3, B.size))
    dense = []
    for hz in B.hz():
        n = int(np.ceil(B.quality * B.rate / hz))
        w = np.hanning(n + 1)[:n]
        part = x[:, (B.size - n) // 2 : (B.size - n) // 2 + n]
        dense.append(np.abs(part @ (w / w.sum() * np.exp(-2j * np.pi * hz * np.arange(n) / B.rate))))
    dense = np.array(dense).T
    got = tones.bands_of(x, B)
    assert np.abs(got - dense).max() < 0.1 * dense.max() and np.corrcoef(got.ravel(), dense.ravel())[0, 1] > 0.999
    assert len(tones.kernels(B)[1]) < 0.01 * B.count * B.size


def tune(rng, seconds, octave=0.0, speed=1.0, rate=16000):
    """Chords that begin at known times; the same seed gives the same ones at another pitch or speed."""
    x = np.zeros(int(seconds * rate / speed))
    at = 0.0
    while at < seconds - 0.4:
        hz = 440 * 2 ** rng.uniform(-1, 2)
        n = int(0.35 * rate)
        start = int(at * rate / speed)
        x[start : start + n] += tone(hz * 2**octave, n) * np.hanning(n) * rng.uniform(0.3, 1)
        at += rng.uniform(0.12, 0.3)
    return (x / np.abs(x).max()).astype(np.float32)


def test_bands_in_chunks_and_a_shifted_tune(spark):
    small = tones.Bands(lowest=220.0, highest=3520.0, octave=24, step=256)
    e, k = tones.settings_of_bands(small), extract.Peaks(bins=6, before=8, after=7, core=300)
    seconds = 40
    signals = {1: tune(np.random.default_rng(1), seconds), 2: tune(np.random.default_rng(2), seconds), 9: tune(np.random.default_rng(1), seconds, 1 / 12)}
    pieces = spark.createDataFrame([(r, a, x[a : a + 20_000].tolist()) for r, x in signals.items() for a in range(0, len(x), 20_000)], "resource_id long, at long, samples array<float>")
    chunks = extract.chunks_of_pieces(pieces, e, k)
    rows = {r.t: r.m for r in tones.band_frames(chunks, small).where("resource_id = 1").collect()}
    whole = tones.bands_of(extract.frames_of(signals[1], e.size, e.step), small)
    assert sorted(rows) == list(range(len(whole))) and np.allclose([rows[t] for t in sorted(rows)], whole)
    prints = tones.tolerant_prints(tones.band_triples(chunks, small, k)).persist()
    asked = prints.where("resource_id = 9").select(F.col("resource_id").alias("query_id"), F.col("t1").cast("long").alias("pos"), "hash", "t1", "f1")
    match = Matching(time_factor=(0.8, 1.2), seconds_per_frame=256 / 16000)
    hits = lookup.near_hits(asked, prints.where("resource_id <> 9"))
    found = align.align_tolerant(hits, lambda f: to_hz(f, 220.0, 24), match).collect()
    assert found and max(found, key=lambda r: r.score).resource_id == 1
    best = max(found, key=lambda r: r.score)
    assert best.time_factor == pytest.approx(1, abs=0.03) and best.frequency_factor == pytest.approx(2 ** (-1 / 12), rel=0.03)


def test_differences():
    x = np.random.default_rng(4).normal(size=(2, 64))
    want = [[sum((r[j] - r[j + lag]) ** 2 for j in range(32)) for lag in range(20)] for r in x]
    assert np.allclose(tones.differences(x, 19), want)


@pytest.mark.parametrize("hz", [61.7, 110.0, 220.5, 441.3, 879.9, 1500.0])
def test_pitch_within_a_cent(hz):
    x = tone(hz, 2048 * 3) + 0.3 * tone(2 * hz, 2048 * 3)
    got = tones.pitches_of(extract.frames_of(x.astype(np.float32), 2048, 1024)[:4])
    assert (np.abs(1200 * np.log2(got / hz)) < 1).all()


def test_no_pitch():
    noise = np.random.default_rng(6).normal(size=(5, 2048))
    assert np.isnan(tones.pitches_of(np.zeros((3, 2048)))).all() and np.isnan(tones.pitches_of(noise)).mean() > 0.7
    assert tones.pitches_of(np.zeros((0, 2048))).shape == (0,)


def test_longest_lag_has_a_bottom_beyond_it():
    """The dip is at the longest lag that counts, and by its parabola more than half a sample later."""
    y, r, n = tones.Yin(size=128, step=64, lowest=300.0, threshold=0.7), np.random.default_rng(0), np.arange(128)
    x = np.sin(2 * np.pi * n / r.uniform(53, 54.5, (500, 1)) + r.uniform(0, 6, (500, 1))) + r.uniform(0, 0.5, (500, 1)) * r.standard_normal((500, 128))
    hz = tones.pitches_of(x.astype(np.float32), y)
    assert np.nanmin(hz) < y.rate / 53.5 and np.nanmin(hz) >= y.rate / 54


def test_from_samples_to_histogram(spark):
    y = tones.Yin()
    e, k = tones.settings_of(y), extract.Peaks(core=8)
    x = np.concatenate([tone(440.0, 32_000), tone(660.0, 16_000), np.zeros(16_000)])
    pieces = spark.createDataFrame([(1, a, x[a : a + 7_000].tolist()) for a in range(0, len(x), 7_000)], "resource_id long, at long, samples array<float>")
    hz = tones.pitches(extract.chunks_of_pieces(pieces, e, k), y)
    counts = {r.bin: r.n for r in pitch.histogram(hz, 12).collect()}
    frames = {r.t: r.hz for r in hz.collect()}
    assert abs(frames[10] - 440) < 0.3 and abs(frames[40] - 660) < 0.5 and 58 not in frames
    assert max(counts, key=counts.get) == 9 and counts[4] >= 14
