"""Sliding extrema against plain ones; prints of sound in chunks against those of the whole; files from sound to catalog."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.config import Extraction
from peakfold.functions.sliding import over_ranges, sliding
from peakfold.operators import extract, pack, peaks
from peakfold.sources import audio
from tests.test_plans import wav

E = Extraction(size=256, step=32)


def tune(seconds, rate=16000, seed=1):
    """Short tones of changing pitch, with some noise."""
    rng = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < seconds * rate:
        n = int(rng.integers(rate // 20, rate // 5))
        out.append(np.sin(2 * np.pi * rng.uniform(300, 3000) * np.arange(n) / rate) * np.hanning(n) * rng.uniform(0.2, 0.6))
    x = np.concatenate(out)[: int(seconds * rate)]
    return (x + rng.normal(0, 0.01, len(x))).astype(np.float32)


@pytest.mark.parametrize(("n", "before", "after"), [(1, 0, 0), (1, 5, 2), (7, 0, 3), (10, 3, 0), (23, 51, 51), (100, 12, 11), (64, 10, 10), (5, 1, 1)])
def test_sliding(n, before, after):
    x = np.random.default_rng(n).integers(0, 20, (3, n)).astype(float)
    for largest, of in ((True, np.max), (False, np.min)):
        want = np.array([[of(r[max(0, i - before) : i + after + 1]) for i in range(n)] for r in x])
        assert (sliding(x, before, after, largest=largest) == want).all()
        assert (sliding(x.T, before, after, 0, largest) == want.T).all()
    assert sliding(np.zeros((2, 0)), before, after).shape == (2, 0)


def test_over_ranges():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 64):
        x = rng.normal(size=(4, n))
        a = rng.integers(0, n, 30)
        b = np.minimum(a + rng.integers(0, n + 1, 30), n + 3)
        got = over_ranges(x, a, b)
        for k in range(30):
            want = x[:, a[k] : b[k]].max(axis=1) if b[k] > a[k] else np.full(4, np.nan)
            assert np.array_equal(got[:, k], want, equal_nan=True)


def test_points_of_chunks_equal_windows(spark):
    rng = np.random.default_rng(3)
    frames = [(r, t, rng.random(40).tolist()) for r, n in ((1, 200), (2, 24), (3, 23)) for t in range(n)]
    df = spark.createDataFrame(frames, "resource_id long, t int, m array<double>")
    rows = df.select("resource_id", "t", F.posexplode("m").alias("f", "m"))
    want = sorted(map(tuple, peaks.event_points(rows).collect()))
    for core in (1024, 50, 7):
        assert sorted(map(tuple, extract.event_points(df, extract.Peaks(core=core)).collect())) == want and len(want) > 5


def whole(x, e=E, k=extract.Peaks()):
    """Prints of a signal in one piece, point by point."""
    m = extract.power(extract.without_impulses(extract.frames_of(x, e.size, e.step)), e)
    at, f = extract.peaks_in(m, k)
    points = [(int(t), int(g) + e.min_bin, m[t, g]) for t, g in zip(at, f, strict=True)]
    near = lambda p, q: e.time_distance[0] <= q[0] - p[0] <= e.time_distance[1] and e.freq_distance[0] <= abs(q[1] - p[1]) <= e.freq_distance[1]
    return sorted((*p, *q, *r) for p in points for q in points if near(p, q) for r in points if near(q, r))


def found(df):
    return sorted(tuple(r)[1:] for r in df.collect())


def test_chunks_of_pieces_equal_the_whole(spark):
    x = tune(3)
    want = whole(x)
    assert len(want) > 200
    cuts = [0, 1, 700, 701, 5000, 20_000, 47_000, len(x)]
    pieces = spark.createDataFrame([(1, a, x[a:b].tolist()) for a, b in zip(cuts, cuts[1:])] + [(2, 0, x[:100].tolist())], "resource_id long, at long, samples array<float>")
    for core in (2500, 400, 64, 3):
        k = extract.Peaks(core=core)
        chunks = extract.chunks_of_pieces(pieces, E, k)
        assert chunks.where("resource_id = 1").count() == -(-1493 // core)
        assert found(extract.triples(chunks, E, k)) == want


def test_chunks_of_files_equal_the_whole(spark):
    x, slow = tune(4, seed=5), tune(4, 8000, 6)
    files = [(1, wav(x)), (2, wav(slow, 8000, 16, 2)), (3, b"no sound"), (4, None), (5, wav(x[:0])), (6, wav(x[:50])), (7, wav(x)[:-9001])]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in files], "resource_id long, content binary")
    sound = extract.sound_files(df, E)
    rows = {r.resource_id: r for r in sound.collect()}
    assert {k for k, r in rows.items() if r.error} == {3, 4} and rows[2].samples == 64_000 and rows[2].seconds == pytest.approx(4) and rows[5].samples == 0
    k = extract.Peaks(core=300)
    chunks = extract.chunks_of_files(sound, E, k)
    assert chunks.where("resource_id = 1").count() == 7 and chunks.agg(F.max(F.length("raw"))).first()[0] < 40_000
    got = extract.triples(chunks, E, k)
    for key, content in files:
        if key in (1, 7):
            _, y = audio.samples_of(content)
            assert found(got.where(F.col("resource_id") == key)) == whole(y)
    _, y = audio.samples_of(files[1][1])
    want = whole(audio.resampled(y, 8000, 16000))
    places = lambda rows: [(r[0], r[1], r[3], r[4], r[6], r[7]) for r in rows]
    assert places(found(got.where("resource_id = 2"))) == places(want) and want
    assert got.where("resource_id in (3, 4, 5, 6)").count() == 0


def test_triples_equal_the_join(spark):
    rng = np.random.default_rng(8)
    t, f = np.sort(rng.integers(0, 300, 150)), rng.integers(0, 200, 150)
    points = spark.createDataFrame([(1, int(a), int(b), 1.0) for a, b in zip(t, f, strict=True)], "resource_id long, t int, f int, m double")
    want = sorted((r.t1, r.f1, r.t2, r.f2, r.t3, r.f3) for r in pack.triples(points).collect())
    for at_once in (200_000, 50):
        got = [p for a, b, c in extract.triples_in(t, f, np.ones(150, bool), Extraction(), at_once) for p in zip(t[a], f[a], t[b], f[b], t[c], f[c], strict=True)]
        assert sorted(tuple(map(int, p)) for p in got) == want


def test_from_files_to_matches(spark, tmp_path):
    from peakfold import commands

    sounds = {"101.wav": tune(30, seed=11), "102.wav": tune(30, seed=12), "103.wav": np.zeros(16000, np.float32)}
    (tmp_path / "in").mkdir()
    (tmp_path / "ask").mkdir()
    for name, x in sounds.items():
        (tmp_path / "in" / name).write_bytes(wav(x))
    (tmp_path / "in" / "104.wav").write_bytes(b"RIFF broken")
    (tmp_path / "ask" / "900.wav").write_bytes(wav(sounds["102.wav"][5 * 16000 : 25 * 16000]))
    run = lambda *a: commands.main(["--base", str(tmp_path / "base"), *a], spark)
    said = run("store-sound", str(tmp_path / "in"))
    assert [s.split('"status": "')[1].split('"')[0] for s in said] == ["ok", "ok", "skipped_empty", "error"] and "not a WAV" in said[3]
    assert ["already_exists" in s for s in run("store-sound", str(tmp_path / "in"))] == [True, True, False, False]
    (hit,) = commands.Engine(spark, str(tmp_path / "base")).query_sound(spark.read.format("binaryFile").load(str(tmp_path / "ask")).select("path", "content"), gated=False).collect()
    assert hit.resource_id == 102 and abs(hit.ref_start - hit.query_start - 5) < 0.1 and math.isclose(hit.time_factor, 1, rel_tol=0.01)
