"""Monitoring, duplicates, catalog, text forms, sound and workers on small cases."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold import strategies
from peakfold.config import Extraction, Matching, Monitoring, Scan
from peakfold.functions import ident
from peakfold.operators import align, duplicates, evaluation, logs, monitor, pack, peaks, pitch
from peakfold.plans.queries import r6
from peakfold.sources import audio, results, scans, textfiles
from peakfold.sources.catalog import Catalog, MemoryCatalog, Tee, load_files, query_prints, requested_ids
from peakfold.streaming import worker

MATCH = Matching(seconds_per_frame=0.1)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def track(k: int, n: int):
    """Prints of a resource: a hash for each frame, far from those of others."""
    return [(1_000_000 * k + 10 * t, k, t) for t in range(n)]


def played(parts, rec=900):
    """A recording's prints: (resource, its first frame, frames, at)."""
    return [(1_000_000 * k + 10 * (a + t), rec, at + t) for k, a, n, at in parts for t in range(n)]


def test_components_of_random_pairs(spark, monkeypatch):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    label = {k: k for e in edges for k in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    pairs = spark.createDataFrame([(*e, 1.0, 1.0) for e in edges if e[0] != e[1]], "a long, b long, coverage_a double, coverage_b double").repartition(3)
    want = {k: v for k, v in label.items() if any(k in e for e in edges if e[0] != e[1])}
    for at_once in (200_000, 25):
        monkeypatch.setattr(duplicates, "CONTRACT", at_once)
        got = duplicates.components(pairs).collect()
        assert {x.id: x.component for x in got} == want and len(got) == len(want)


def test_components_raise_when_rounds_run_out(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CONTRACT", 4)
    pairs = spark.createDataFrame([(k, k + 1, 1.0, 1.0) for k in range(40)], "a long, b long, coverage_a double, coverage_b double").repartition(4)
    assert {r.component for r in duplicates.components(pairs).collect()} == {0}
    with pytest.raises(RuntimeError):
        duplicates.components(pairs, most=1)


def test_pair_scores_at_the_strongest_bucket(spark):
    shift = Scan().shift // 4
    rows = [(1, 2, shift, 300, range(60), range(60)), (1, 2, shift + 1, 200, range(55, 98), range(55, 97)), (1, 2, shift + 40, 50, [99], [99])]
    far = 70_000  # seconds from there on are in other bitmaps
    raw = spark.createDataFrame([(a, b, k, x + far, y + far) for a, b, k, _, p, q in rows for x, y in zip([*p, 97 if k > shift else 59], [*q, 96 if k > shift else 59])], "a long, b long, bucket long, sa long, sb long")
    counts = spark.createDataFrame([r[:4] for r in rows], "a long, b long, bucket long, hits long")
    track = spark.createDataFrame([(k, 125 * (x + far)) for k in (1, 2) for x in range(100)], "resource_id long, t1 int")
    near = duplicates.at_peak(counts, 3)
    seconds, owned = duplicates.pair_seconds(raw, near), duplicates.track_seconds(track)
    r = duplicates.score_pairs(near, seconds, owned).first()
    assert (r.aligned_hits, r.coverage_a, r.coverage_b) == (500, 0.98, 0.97) and r.offset_seconds == pytest.approx(2 / 125)
    assert owned.agg(F.max(F.length("bits"))).first()[0] == 4096
    assert duplicates.score_pairs(near, seconds, owned, Scan(min_similarity=0.98)).count() == 0
    assert duplicates.score_pairs(near, seconds, owned.limit(0)).count() == 0


def test_verification_of_a_kept_resource(spark):
    rows = [x for k in range(100) for x in ((k, 7, 25 * k), (k, 3, 25 * k + 2), (1000 + k, 9, 25 * k), (1000 + k, 7, 25 * k + 6250))]
    index = spark.createDataFrame(rows, "hash long, resource_id long, t1 int")
    asked = spark.createDataFrame([(7, 3), (7, 9)], "keep long, other long")
    pairs = duplicates.verify(index, asked)
    (r,) = pairs.collect()
    assert (r.a, r.b, r.coverage_a, r.coverage_b) == (3, 7, 1.0, 0.5) and abs(r.offset_seconds + 0.016) <= 0.02
    seen = {x.other: x for x in duplicates.decided(duplicates.from_kept_side(pairs, asked), 0.4).collect()}
    assert seen[3].verified and not seen[9].verified and not seen[3].allowed
    assert (seen[3].coverage_keep, seen[3].coverage_other) == (0.5, 1.0) and seen[3].offset_seconds == -r.offset_seconds
    out = json.loads(results.deletion_json(duplicates.decided(duplicates.from_kept_side(pairs, asked), 0.4), 0.4).first().json)
    assert out["status"] == "rejected" and [t["resource_id"] for t in out["tracks"]] == [3, 9] and "coverage_keep" not in out["tracks"][1]


def test_listing_order(spark):
    pairs = spark.createDataFrame([(10, 20, 0.99, 0.98), (20, 30, 0.97, 0.96), (40, 50, 0.70, 0.68), (60, 70, 0.98, 0.99)], "a long, b long, coverage_a double, coverage_b double")
    rows = duplicates.listing(pairs, duplicates.components(pairs)).collect()
    assert [(r.component, r.size, r.members) for r in rows] == [(10, 3, [10, 20, 30]), (60, 2, [60, 70]), (40, 2, [40, 50])]
    assert [(p.a, p.b) for p in rows[0].pairs] == [(10, 20), (20, 30)]


def test_scan_store(spark, tmp_path):
    store = scans.ScanStore(spark, str(tmp_path / "scans"))
    assert store.latest() is None and not store.complete()
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.9)], "a long, b long, coverage_a double, coverage_b double")
    none = spark.createDataFrame([], "resource_id long")
    store.save("s1", pairs.limit(0), none)
    store.save("s2", pairs, none)
    assert store.latest().scan_id == "s2" and store.pairs().count() == 1 and store.complete()
    assert not (tmp_path / "scans" / "pairs-s1").exists()
    log = spark.createDataFrame([(k, f"{k}.x") for k in range(5)], "resource_id long, stem string").select(F.current_timestamp().alias("deleted_at"), F.lit("s2").alias("scan_id"), F.lit(1).cast("long").alias("keep"), F.lit("1").alias("keep_stem"), "resource_id", "stem", F.lit(0.9).alias("similarity"), F.lit("scan:s2").alias("verified_on"), F.lit(3).cast("long").alias("fingerprints_deleted"))
    store.log_deletions(log)
    store.save("s3", pairs, none)
    assert [r.resource_id for r in store.deletions(2, 1).collect()] == [1, 2] and store.deletions().count() == 5
    with pytest.raises(ValueError):
        store.deletions(0)


def test_catalog_generations(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    assert cat.metadata().count() == 0 and cat.fingerprints().count() == 0
    prints = spark.createDataFrame([(5, 1, 0, 7), (6, 1, 1, 8), (5, 2, 0, 9)], "hash long, resource_id long, t1 int, f1 int")
    meta = spark.createDataFrame([(1, "a.mp3", 0.0, 0), (2, "b.mp3", 1.0, 1)], "resource_id long, path string, duration double, num_fingerprints long")
    cat.store(prints, meta)
    whole = meta.withColumns({"duration": F.lit(2.0), "num_fingerprints": F.lit(2).cast("long")})
    cat.restore_incomplete(prints, whole)
    assert cat.generation() == 1 and cat.fingerprints().count() == 3
    assert {(r.resource_id, r.duration) for r in cat.metadata().collect()} == {(1, 2.0), (2, 1.0)}
    assert {r.f1 for r in cat.lookup(spark.createDataFrame([(5,)], "hash long")).collect()} == {7, 9}
    assert cat.lookup(spark.createDataFrame([], "hash long")).count() == 0
    for ids in (range(101), []):
        with pytest.raises(ValueError):
            requested_ids(spark, list(ids))
    many = spark.range(2, 5000).select(F.col("id").alias("resource_id"))
    assert {r.resource_id: r.fingerprints_deleted for r in cat.delete(many, by_rows=True).where("fingerprints_deleted > 0").collect()} == {2: 1}
    assert cat.delete(many).agg(F.sum("fingerprints_deleted")).first()[0] == 0 and cat.delete(many.limit(0)).isEmpty()
    (tmp_path / "cat" / "7" / "metadata").mkdir(parents=True)  # a rewrite that was cut off before its mark
    assert cat.generation() == 1 and cat.metadata().count() == 1
    cat.compact()
    assert cat.generation() == 2 and cat.fingerprints().count() == 2 and (tmp_path / "cat" / "1").exists() and not (tmp_path / "cat" / "0").exists()


def test_tee_files_and_memory(spark, tmp_path):
    prints = spark.createDataFrame([(5, 1, 0, 7), (-6, 1, 1, 8), (5, 2, 0, 9)], "hash long, resource_id long, t1 int, f1 int")
    meta = spark.createDataFrame([(1, "a b.mp3", 2.5, 2), (2, "b.mp3", 1.0, 1)], "resource_id long, path string, duration double, num_fingerprints long")
    files = str(tmp_path / "files")
    tee = Tee(Catalog(spark, str(tmp_path / "a")), files)
    tee.store(prints, meta)
    other = Catalog(spark, str(tmp_path / "b"))
    for _ in range(2):
        load_files(other, files)
    key = lambda df: sorted((r.hash, r.resource_id, r.t1, r.f1) for r in df.collect())
    assert key(other.fingerprints()) == key(tee.fingerprints()) == key(prints)
    assert {r.path for r in other.metadata().collect()} == {"a b.mp3", "b.mp3"} and tee.metadata().count() == 2
    odd = spark.createDataFrame([("1 2 3",), ("x",), ("",), (" 1  2 3 4 ",)], "line string")
    assert [r.f1 for r in textfiles.parsed_prints(odd).collect()] == [None, 4]
    mem = MemoryCatalog(prints, meta)
    assert mem.delete(spark.createDataFrame([(1,)], "resource_id long")).fingerprints().count() == 1


def test_monitor_finds_both_plays_and_refines(spark):
    index = spark.createDataFrame(track(1, 2000) + track(2, 400) + track(3, 3000), "hash long, resource_id long, t1 int")
    parts = [(1, 0, 900, 35), (1, 0, 700, 3000), (2, 0, 400, 1500)]
    rec = spark.createDataFrame(played(parts), "hash long, recording long, t1 int")
    length = spark.createDataFrame([(900, 4000)], "recording long, total long")
    duration = spark.createDataFrame([(1, 2000.0), (2, 400.0), (3, 3000.0)], "resource_id long, duration double")
    rows = monitor.monitor(rec, length, index, duration, MATCH)
    got = {(r.resource_id, r.cluster): (r.start, r.stop, r.ref_start) for r in rows.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    assert got[1, 0] == (35, 934, 0) and got[1, 1] == (3000, 3699, 0) and got[2, 0] == (1500, 1899, 0)
    tracks = monitor.tracks_of(rows, Monitoring(), 0.1)
    out = {r.resource_id: r for r in tracks.collect()}
    assert len(out[1].windows) == 2 and out[1].query_start == pytest.approx(3.5) and out[1].query_stop == pytest.approx(369.9)
    meta = spark.createDataFrame([(1, "m/a.mp3", None), (2, "m/b.mp3", "t")], "resource_id long, path string, title string")
    text = json.loads(results.monitor_json(tracks, meta).first().json)
    assert text["unique_tracks_count"] == 2 and [m["identifier"] for m in text["matches"]] == [1, 2] and text["matches"][0]["title"] is None
    assert text["matches"][1]["query_start_time"] == "00:02:30" and len(text["matches"][0]["windows"]) == 2
    assert monitor.monitor(rec.limit(0), length, index, duration, MATCH).count() == 0


def test_whole_copies_need_every_window(spark):
    index = spark.createDataFrame(track(1, 4000) + track(2, 900), "hash long, resource_id long, t1 int")
    rec = played([(1, 100, 3050, 0)], 900) + played([(1, 0, 900, 0), (2, 0, 900, 900)], 901) + played([(1, 0, 100, 0)], 902)
    length = spark.createDataFrame([(900, 3050), (901, 1800), (902, 100)], "recording long, total long")
    found = monitor.whole_copies(spark.createDataFrame(rec, "hash long, recording long, t1 int"), length, index, MATCH).collect()
    assert [(r.recording, r.resource_id) for r in found] == [(900, 1)]
    at = [r["at"] for r in monitor.long_windows(spark.createDataFrame([(1, 3050)], "recording long, total long"), 10.0).orderBy("win").collect()]
    assert at[0] == 0 and at[-1] == 2750 and max(b - a for a, b in zip(at, at[1:])) <= 300


def test_fallback_only_for_queries_without_a_line(spark):
    line = [(1, k, k, 1000 + 10 * k, 10 * k, 7) for k in range(60)]
    r = random.Random(1)
    jitter = [(2, k, k, 500 + 10 * k + r.choice([0, 1, 2, 3, 4]), 10 * k, 8) for k in range(60)]
    hits = spark.createDataFrame(line + jitter, "query_id long, near_hash long, original_hash long, match_time int, query_time int, resource_id long")
    narrow = Matching(seconds_per_frame=0.1, range=0, min_seconds_with_match=0.2, time_factor=(0.9999, 1.0001))
    plain = {(x.query_id, x.resource_id) for x in align.align(hits, narrow).collect()}
    both = {(x.query_id, x.resource_id): x.score for x in align.with_fallback(hits, narrow).collect()}
    assert (1, 7) in plain and both[1, 7] == 60 and both[2, 8] == 60


def test_tolerant_matches(spark):
    speed, rows = 1.1, []
    for k in range(300):
        q = 10 * k
        rows.append((1, k, k, 1000 + round(q / speed), q, 7, 110, 100))
    hits = spark.createDataFrame(rows, "query_id long, near_hash long, original_hash long, match_time int, query_time int, resource_id long, match_f1 int, query_f1 int")
    assert align.align(hits, MATCH).count() == 0 or abs(align.align(hits, MATCH).first().time_factor - 1.0) < 0.1
    (r,) = align.align_tolerant(hits, strategies.to_hz, Matching(time_factor=(0.8, 1.2), seconds_per_frame=0.1, range=4)).collect()
    assert r.time_factor == pytest.approx(1 / speed, abs=0.02) or r.time_factor == pytest.approx(speed, abs=0.02)
    assert r.frequency_factor == pytest.approx(2 ** (10 / 85), rel=1e-6)
    high = hits.withColumn("match_f1", F.lit(200))
    assert align.align_tolerant(high, strategies.to_hz, Matching(time_factor=(0.8, 1.2), seconds_per_frame=0.1, range=4)).count() == 0


def test_strategies(spark):
    index = spark.createDataFrame([(h, k, t, 50) for h, k, t in track(1, 300) + track(2, 300)], "hash long, resource_id long, t1 int, f1 int")
    prints = spark.createDataFrame([(9, t, 1_000_000 + 10 * (t + 50), t, 50) for t in range(150)], "query_id long, pos long, hash long, t1 int, f1 int")
    meta = spark.createDataFrame([(1, "a", 30.0, 300)], "resource_id long, path string, duration double, num_fingerprints long")
    for name in ("exact", "TOLERANT"):
        (r,) = strategies.strategy(name).query(prints, index, meta, MATCH if name == "exact" else Matching(time_factor=(0.8, 1.2), seconds_per_frame=0.1)).collect()
        assert (r.resource_id, r.path, r.score) == (1, "a", 150)
    h = spark.createDataFrame([(1, 0, 5), (1, 300, 2), (2, 10, 5), (2, 310, 2), (3, 0, 1)], "resource_id long, bin int, n long")
    got = {(r.query_id, r.resource_id): (r.shift, r.match) for r in strategies.strategy("pitch").query(h.where("resource_id = 1"), h, meta).collect()}
    assert got[1, 1] == (0, 1.0) and got[1, 2] == (1190, 1.0) and got[1, 3][1] == pytest.approx(1 / 7)
    with pytest.raises(ValueError):
        strategies.strategy("none")


def test_key_ranges():
    e = Extraction()
    ranges = peaks.key_ranges(e)
    assert len(ranges) == 503 and all(9 <= a < b <= 512 for _, a, b in ranges) and ranges[0][0] == 9
    key = [peaks.midi_key(f * 15.625 + 7.8125) for f in range(512)]
    for f, a, b in ranges[40::50]:
        assert abs(key[a] - (key[f] - 10)) <= 1 and (b == 512 or abs(key[b - 1] - (key[f] + 10)) <= 1)


def test_range_max_equals_a_loop(spark):
    r = np.random.default_rng(1)
    m = r.random((3, 64))
    ranges = [(f, max(9, f - 3), min(64, f + 4)) for f in range(9, 64)]
    spec = spark.createDataFrame([(1, t, f, float(m[t, f])) for t in range(3) for f in range(64)], "resource_id long, t int, f int, m double")
    got = {(x.t, x.f): x.vmax for x in peaks.range_max(spec, ranges).collect()}
    assert got == {(t, f): m[t, a:b].max() for t in range(3) for f, a, b in ranges}


def test_power_spectrum_of_a_tone(spark):
    e = Extraction()
    x = np.sin(2 * np.pi * 50 * np.arange(1024) / 1024)
    rows = peaks.power_spectrum(spark.createDataFrame([(1, 0, [float(v) for v in x]), (2, 0, [0.0]), (3, 0, [])], "resource_id long, t int, samples array<float>"), e).collect()
    best = max(rows, key=lambda r: r.m)
    assert len(rows) == 503 and (best.resource_id, best.f) == (1, 50) and best.m == pytest.approx(512**2, rel=1e-3)


def test_impulses_give_no_points(spark):
    frames = [(1, t, [0.0] * 100 + [1 / 32767 if t in (20, 50, 80, 120) else 0.0] + [0.0] * 923) for t in range(150)]
    df = spark.createDataFrame(frames, "resource_id long, t int, samples array<float>").withColumn("samples", peaks.suppress_impulse(F.col("samples")))
    assert peaks.event_points(peaks.power_spectrum(df)).count() == 0


def test_robust_hash(spark):
    p = spark.createDataFrame([(1, 0, 100, 3.0), (1, 10, 110, 2.0), (1, 30, 90, 1.0)], "resource_id long, t int, f int, m double")
    part = lambda x, high: math.floor((math.log(x) + math.log(high)) / (2 * math.log(high)) * 512 + 0.5)
    f, t = part(0.5, 126), part(0.5, 15)
    z = sum((f >> k & 1) << 2 * k | (t >> k & 1) << 2 * k + 1 for k in range(16)) & 262143
    assert pack.triples(p).select(pack.robust_hash().alias("h")).first().h == z + (1 << 19) + (1 << 21) + (1 << 22)


def wav(x, rate=16000, bits=16, channels=1):
    raw = {8: lambda v: (v * 127 + 128).astype("u1"), 16: lambda v: (v * 32767).astype("<i2"), 32: lambda v: (v * 2147483000).astype("<i4")}[bits](np.repeat(x, channels)).tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(("bits", "channels", "rate"), [(16, 1, 16000), (8, 2, 16000), (32, 1, 8000)])
def test_sound_files(spark, bits, channels, rate):
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate) / 2
    files = spark.createDataFrame([(1, bytearray(wav(x, rate, bits, channels))), (2, bytearray(b"no sound")), (3, None)], "resource_id long, content binary")
    rows = audio.decoded(files).orderBy("t").collect()
    assert {r.resource_id for r in rows} == {1} and len(rows) == 118 and all(len(r.samples) == 1024 for r in rows)
    best = max(peaks.power_spectrum(audio.decoded(files).where("t = 10")).collect(), key=lambda r: r.m)
    assert best.f in (28, 29)


def test_durations(spark):
    of = lambda h, k: one(spark, audio.duration(F.lit(h).cast("double"), F.lit(k), F.lit(7.0)))
    assert [of(5.0, "mp3"), of(5.0, "M4A"), of(None, "mp3"), of(float("nan"), "mp3"), of(0.0, "mp3"), of(90000.0, "mp3")] == [5.0, 7.0, 7.0, 7.0, 7.0, 7.0]
    said = lambda t: one(spark, audio.duration_or_decoded(F.lit(t), F.lit(7.0)))
    assert [said(" 12.5\n"), said("N/A"), said("-1"), said(None)] == [12.5, 7.0, 7.0, 7.0]


def test_metadata_lines_and_numbers(spark):
    line = one(spark, ident.metadata_text(F.lit(5), F.lit("a/b.mp3"), F.lit(2.5), F.lit(10)))
    assert line == "5 ; a/b.mp3 ; 2.500 (s) ; 10 (#) ; 4.000 (#/s)"
    assert tuple(one(spark, ident.parsed_metadata(F.lit(line)))) == (2.5, 10) and one(spark, ident.parsed_metadata(F.lit("a;b"))) is None
    assert one(spark, ident.one_decimal(F.lit(305.25))) == "305.3" and one(spark, ident.percent(F.lit(0.998))) == "99.8"
    assert [one(spark, ident.elapsed(F.lit(x))) for x in (7200.0, 90.0, 2.0, 0.5)] == ["2.0 h", "1.5 m", "2.0 s", "500.0 ms"]
    assert one(spark, ident.convert_time(F.lit(2.0), "hours", "seconds")) == 7200.0


@pytest.mark.parametrize("value", ["null", "false", "42", "[]", "{}"])
def test_request_text_of_another_type(spark, value):
    assert one(spark, ident.json_text(F.lit('{"filename": ' + value + ', "x": "y"}'), "filename")) is None


def test_result_lines_are_rounded_as_doubles(spark):
    """0.575 is a little less than that, so SQL rounds it down."""
    row = "'q' query_path, 'r' ref_path, 2L resource_id, 0.0D query_start, 9.0D query_stop, 0.0D ref_start, 9.0D ref_stop, 8L score, 1.0005D time_factor, 1.0D frequency_factor, 0.575D share"
    line = spark.range(1).selectExpr(*row.split(", ")).select(results.result_line(F.lit(0), F.lit(0)).alias("x")).first().x
    assert line == "0 ; 0 ; q ; 0.000 ; 9.000 ; r ; 2 ; 0.000 ; 9.000 ; 8 ; 1.001 % ; 1.000 %; 0.57"


def test_six_decimals_are_those_of_doubles(spark):
    """A coverage of 323 of 640 seconds is a tie as a decimal and a little less than that as a double."""
    assert [one(spark, r6(F.lit(x))) for x in (323 / 640, -323 / 640, 0.5, 1.0)] == [0.504687, -0.504687, 0.5, 1.0]


def test_request_fields(spark):
    body = F.lit('{"filename": "a \\"b\\".mp3", "keep": -3, "delete": [1, 2 ,3], "bad": [1, "x"], "dry_run": false, "s": 1e-1}')
    assert one(spark, ident.json_text(body, "filename")) == 'a "b".mp3' and one(spark, ident.json_long(body, "keep")) == -3
    assert one(spark, ident.json_longs(body, "delete")) == [1, 2, 3] and one(spark, ident.json_longs(body, "bad")) is None and one(spark, ident.json_longs(F.lit('{"d": []}'), "d")) == []
    assert one(spark, ident.json_boolean(body, "dry_run")) is False and one(spark, ident.fraction(ident.json_number(body, "s"), 0.5)) == 0.1
    assert one(spark, ident.fraction(F.lit(1.5), 0.5)) is None and one(spark, ident.fraction(F.lit(None).cast("double"), 0.5)) == 0.5


def test_query_names(spark):
    q = one(spark, ident.query_name(F.lit("/x/my_track_10s-20s___speed_up_1.04.mp3")))
    assert tuple(q) == ("my_track", 10, 20, "speed_up", "1.04")
    assert tuple(one(spark, ident.query_name(F.lit("t_0s-5s.gsm")))) == ("t", 0, 5, "", "") and one(spark, ident.query_name(F.lit("t.mp3"))) is None
    rows = evaluation.expected(spark.createDataFrame([("t_0s-5s.mp3", "m/t.mp3"), ("t_0s-5s.mp3", "m/u.mp3"), ("odd", "odd")], "query string, ref string")).collect()
    assert [r.right for r in rows] == [True, False, False]


def test_content_hash_of_the_middle(spark):
    from tests.test_operators import murmur

    for data in (b"", b"abc", bytes(range(256)) * 300):
        first = len(data) // 2 // 8192 * 8192
        assert one(spark, ident.content_hash(F.lit(data))) == murmur(data[first : first + 65536])


def test_logs(spark):
    r = random.Random(2)
    values = [r.randrange(40) for _ in range(300)]
    log = spark.createDataFrame([(k % 3, float(v), 1 << 20) for k, v in enumerate(values)], "c long, elapsed double, bytes long")
    for x in logs.query_log(log, "c").collect():
        mine = sorted(values[x.c :: 3])
        assert (x.queries, x.p95, x.most, x.mib) == (100, mine[94], max(mine), 1.0)
    assert one(spark, logs.key_values(F.lit("A x=1 y=a=b z"))) == {"x": "1", "y": "a=b"}
    text = "OutOfMemoryError java.lang.OutOfMemoryError -XX:+ExitOnOutOfMemoryError OutOfMemoryErrors"
    assert one(spark, logs.occurrences(F.lit(text))) == 2


def test_file_lists(spark):
    arguments = spark.createDataFrame([("a.mp3", 10), ("big.mp3", 10_000_000), ("list.TXT", 5)], "path string, bytes long")
    lists = spark.createDataFrame([("list.TXT", " b.mp3 "), ("list.TXT", ""), ("list.TXT", "a.mp3")], "path string, line string")
    got = textfiles.expanded_files(arguments, lambda p: lists.join(p, "path", "left_semi"), 1.0)
    assert sorted(r.file for r in got.collect()) == ["a.mp3", "b.mp3"]


def test_histogram_text(spark):
    rows = spark.createDataFrame([(1, "d e", 0, 3), (1, "d e", 1199, 2)], "resource_id long, description string, bin int, n long")
    text = textfiles.histogram_text(rows)
    assert text.first().text.count("\n") == 1200
    assert sorted(map(tuple, textfiles.parsed_histogram(text).collect())) == [(1, "d e", 0, 3), (1, "d e", 1199, 2)]


def test_best_shift_equals_a_loop(spark):
    r = random.Random(3)
    h = {k: {r.randrange(24): r.randint(1, 5) for _ in range(6)} for k in range(8)}
    df = spark.createDataFrame([(k, b, n) for k, x in h.items() for b, n in x.items()], "resource_id long, bin int, n long")
    for x in pitch.best_shift(df.where("resource_id < 3"), df, 24).collect():
        q, ref = h[x.q], h[x.r]
        sums = [sum(min(n, ref.get((b - s) % 24, 0)) for b, n in q.items()) for s in range(24)]
        assert x["shift"] == sums.index(max(sums)) and x.match == pytest.approx(max(sums) / max(sum(q.values()), sum(ref.values())))


def test_best_references_by_bounds(spark):
    r = random.Random(6)
    shapes = [{r.randrange(1200): r.randint(1, 60) for _ in range(r.choice([3, 8, 40]))} for _ in range(25)]
    h = {k: {(b + 97 * k) % 1200: n for b, n in shapes[k % 25].items()} for k in range(150)}
    table = lambda keys: spark.createDataFrame([(k, b, n) for k in keys for b, n in h[k].items()], "resource_id long, bin int, n long")
    queries, all_ = table(range(0, 150, 10)), table(h)
    every = {(x.q, x.r): (x.match, x["shift"]) for x in pitch.best_shift(queries, all_, 1200).collect()}
    got = {}
    for x in pitch.best_references(queries, all_, 1200).collect():
        assert every[x.q, x.r] == (x.match, x["shift"])
        got.setdefault(x.q, {})[x.place] = x.r
    for q, places in got.items():
        want = sorted((k[1] for k in every if k[0] == q), key=lambda k: (-round(every[q, k][0], 9), k))[:10]
        assert [places[k] for k in range(1, 11)] == want
    seen = pitch.block_references(queries, all_, 1200).select("q", "compared", "of").distinct().collect()
    assert len(seen) == 15 and sum(x.compared for x in seen) < 0.9 * sum(x.of for x in seen)


def test_bounds_are_never_below_the_best_overlap():
    r = np.random.default_rng(7)
    for few in (1, 12, 60, 1200):
        for _ in range(20):
            q, x = ((k, np.sort(r.choice(1200, n, False)), r.integers(1, 9, n)) for k, n in enumerate(r.integers(1, 60, 2)))
            best = pitch._overlaps(q, [x], 1200).max()
            assert pitch.bounds(pitch.coarse([q], 1200, few)[0], pitch.coarse([x], 1200, few))[0] >= best


def messages(spark, tmp_path, values):
    (tmp_path / "in").mkdir(exist_ok=True)
    for k, v in enumerate(values):
        (tmp_path / "in" / f"{k:03d}.json").write_text(json.dumps({"key": f"k{k:03d}", "value": v if isinstance(v, str) else json.dumps(v)}))
    return spark.readStream.schema(worker.MESSAGE).json(str(tmp_path / "in"))


def run(stream, handler, tmp_path):
    q = stream.writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    if q.exception():
        raise q.exception()


def body(k, prints, **more):
    return {"identifier": k, "filename": f"{k}.mp3", "duration": 60.0, "fingerprints": [{"hash": h, "t1": t} for h, _, t in prints]} | more


def test_store_requests(spark, tmp_path):
    cat, out = Catalog(spark, str(tmp_path / "cat")), []
    cat.store(spark.createDataFrame(track(1, 600), "hash long, resource_id long, t1 int"), spark.createDataFrame([(1, "1.mp3", 60.0, 600)], "resource_id long, path string, duration double, num_fingerprints long"))
    copy = [(h, 5, t) for h, _, t in track(1, 600)]
    stream = messages(spark, tmp_path, [body(1, track(1, 600)), body(5, copy), body(6, track(6, 600)), body(6, track(6, 600)), body(7, []), "broken"])
    seen = []

    def publish(rows):
        seen.append(cat.metadata().where("resource_id = 6").count())  # stored before its result goes out
        out.extend(rows.collect())

    run(stream, worker.store_batch(cat, publish, MATCH), tmp_path)
    assert {r.key: (r.status, r.original) for r in out} == {"k000": ("already_exists", None), "k001": ("already_indexed_match", 1), "k002": ("ok", None), "k003": ("repeated", None), "k004": ("skipped_empty", None), "k005": ("error", None)}
    assert seen == [1] and cat.fingerprints().count() == 1200


def test_patch_requests_in_order(spark, tmp_path):
    cat, out = Catalog(spark, str(tmp_path / "cat")), []
    meta = spark.createDataFrame([(k, f"{k}.mp3", 1.0, 1) for k in (1, 2, 3)], "resource_id long, path string, duration double, num_fingerprints long")
    cat.store(spark.createDataFrame([(k, k, 0) for k in (1, 2, 3)], "hash long, resource_id long, t1 int"), meta)
    stream = messages(spark, tmp_path, [{"identifier": 1, "new_path": "a"}, {"identifier": 1, "new_path": "b"}, {"action": "delete", "identifier": 2}, {"identifier": 2, "new_path": "late"}, {"resource_id": 9, "new_path": "x"}, {"action": "explode", "identifier": 3}, {"identifier": 3, "new_path": 4}])
    run(stream, worker.patch_batch(cat, lambda rows: out.extend(rows.collect())), tmp_path)
    assert [r.status for r in sorted(out, key=lambda r: r.key)] == ["ok", "ok", "ok", "not_found", "not_found", "error", "error"]
    assert {r.resource_id: r.path for r in cat.metadata().collect()} == {1: "b", 3: "3.mp3"}


def test_monitor_requests(spark, tmp_path):
    cat, out = Catalog(spark, str(tmp_path / "cat")), []
    cat.store(spark.createDataFrame(track(1, 900), "hash long, resource_id long, t1 int"), spark.createDataFrame([(1, "1.mp3", 90.0, 900)], "resource_id long, path string, duration double, num_fingerprints long"))
    heard = [(h, 900, t) for h, _, t in played([(1, 0, 900, 100)])]
    stream = messages(spark, tmp_path, [body(900, heard), body(901, track(4, 900)), body(902, heard, segments=[{"start_seconds": 300, "end_seconds": 400}]), "{}"])
    run(stream, worker.monitor_batch(cat, lambda rows: out.extend(rows.collect()), MATCH), tmp_path)
    got = {r.key: json.loads(r.json) for r in out}
    assert got["k000"]["matches"][0]["identifier"] == 1 and got["k000"]["matches"][0]["query_start_seconds"] == 10.0
    assert got["k001"]["unique_tracks_count"] == got["k002"]["unique_tracks_count"] == 0 and got["k003"]["status"] == "error"


def test_worker_modes(spark, tmp_path):
    seen = []
    sources = {kind: messages(spark, tmp_path, ["{}"]) for kind in ("store", "monitor", "patch")}
    handlers = {kind: (lambda batch, n, kind=kind: seen.append(kind)) for kind in sources}
    queries = worker.start_workers(spark, "stage1", sources, handlers, str(tmp_path / "cks"))
    for q in queries:
        q.processAllAvailable()
        q.stop()
    assert sorted(set(seen)) == ["monitor", "store"]
    with pytest.raises(ValueError):
        worker.start_workers(spark, "x", {}, {}, "")


def test_results_go_to_the_second_place_when_the_first_fails(spark):
    def broken(rows):
        raise OSError("gone")

    out = []
    worker.routed(broken, out.append)(1)
    with pytest.raises(OSError):
        worker.routed(broken, broken)(1)
    assert out == [1]


def test_event_time_windows(spark, tmp_path):
    rows = [("2024-01-01T00:05:00", "a", 1.0), ("2024-01-01T00:25:00", "a", 2.0), ("2024-01-01T03:00:00", "a", 4.0)]
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "0.json").write_text("\n".join(json.dumps({"ts": t, "event_type": e, "value": v}) for t, e, v in rows))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "ev"))
    q = worker.hopping(stream).writeStream.format("memory").queryName("hops").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start.strftime("%H:%M"): (r.n, r.total) for r in spark.table("hops").collect()}
    assert got["00:00"] == (2, 3.0) and got["00:20"] == (1, 2.0) and len(got) == 5


def test_query_requests(spark):
    value = json.dumps({"fingerprints": [{"hash": 5, "t1": 2}, {"hash": -1, "t1": 2}, {"t1": 4}, {"hash": 7, "t1": 3, "f1": 1}]})
    got = query_prints(spark.createDataFrame([(1, value), (2, "broken")], "query_id long, value string")).collect()
    assert [(r.query_id, r.pos, r.hash, r.t1) for r in got] == [(1, 0, 5, 2), (1, 3, 7, 3)]


def test_murmur_128(spark):
    got = spark.createDataFrame([("foo",), ("",), (None,)], "t string").select(ident.murmur3_128(F.col("t")).alias("h")).collect()
    assert tuple(got[0].h) == (-2129773440516405919, 9128664383759220103) and tuple(got[1].h) == tuple(got[2].h) == (0, 0)


def test_band_spectrum_of_a_tone(spark):
    x = [float(v) for v in np.sin(2 * np.pi * 440 * np.arange(8192) / 16000)]
    rows = peaks.band_spectrum(spark.createDataFrame([(1, 0, x), (2, 0, [])], "resource_id long, t int, samples array<float>")).collect()
    best = max(rows, key=lambda r: r.m)
    assert len(rows) == 510 and best.resource_id == 1 and abs(best.f - 170) <= 1 and best.m == pytest.approx(0.5, rel=0.02)


def test_engine_and_commands(spark, tmp_path):
    from peakfold import commands

    base = str(tmp_path / "base")
    prints = spark.createDataFrame(track(1, 600) + [(h, 2, t) for h, _, t in track(1, 600)] + track(3, 500), "hash long, resource_id long, t1 int")
    meta = spark.createDataFrame([(1, "1.mp3", 60.0, 600), (2, "2.mp3", 60.0, 600), (3, "3.mp3", 50.0, 500)], "resource_id long, path string, duration double, num_fingerprints long")
    prints.write.parquet(f"{base}/in/prints")
    meta.write.parquet(f"{base}/in/meta")
    run = lambda *a: commands.main(["--base", base, *a], spark)
    assert run("store", f"{base}/in/prints", f"{base}/in/meta") == ["ok"]
    assert json.loads(run("stats")[0])["resources"] == 3 and run("resolve", "x/77.mp3") == ['{"path": "x/77.mp3", "resource_id": 77}']
    assert run("metadata", "3") == ["3 ; 3.mp3 ; 50.000 (s) ; 500 (#) ; 10.000 (#/s)"] and len(run("print", "3")) == 500
    e = commands.Engine(spark, base, match=MATCH)
    asked = spark.createDataFrame([(9, t, h, t) for h, _, t in track(3, 300)], "query_id long, pos long, hash long, t1 int")
    assert [r.resource_id for r in e.query(asked).collect()] == [3] and e.query(asked, avoid=spark.createDataFrame([(3,)], "resource_id long")).count() == 0
    assert e.same(prints.where("resource_id = 1").select("hash", "t1"), prints.where("resource_id = 2").select("hash", "t1")) == 1.0
    assert e.same(prints.where("resource_id = 1").select("hash", "t1"), prints.where("resource_id = 3").select("hash", "t1")) == 0.0
    heard = e.monitor(spark.createDataFrame(played([(3, 0, 500, 0)]), "hash long, recording long, t1 int")).first()
    assert json.loads(heard.json)["matches"][0]["identifier"] == 3
    with pytest.raises(LookupError):
        e.delete_duplicates(1, [2])
    assert e.scan("s1", Scan(frames_per_second=10.0, max_offset_frames=100)) == 1
    assert json.loads(run("duplicates")[0])["members"] == [1, 2]
    assert e.delete_duplicates(1, [2])["status"] == "dry_run" and e.delete_duplicates(1, [3])["status"] == "rejected"
    assert e.delete_duplicates(1, [2], dry_run=False)["tracks"][0]["fingerprints_deleted"] == 600
    assert e.duplicates().count() == 0 and e.scans.deletions().first().stem == "2"
    assert run("compact") == ["ok"] and e.catalog.fingerprints().count() == 1100 and run("clear") == ["ok"] and json.loads(run("stats")[0])["resources"] == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_catalog_rewrite_leaves_out_ids(spark, tmp_path, monkeypatch, most):
    """Prints are written as they come, and dealt out once by a rewrite; the ids left out meet them by broadcast while they are few."""
    from peakfold.sources import catalog

    monkeypatch.setattr(catalog, "MOST_BROADCAST", most)
    cat = Catalog(spark, str(tmp_path / "cat"))
    prints = spark.createDataFrame([(h, r, h) for r in (1, 2, 3) for h in range(40)], "hash long, resource_id long, t1 int").repartition(3)
    meta = spark.createDataFrame([(1, "a", 2.0, 40), (2, "b", 2.0, 40)], "resource_id long, path string, duration double, num_fingerprints long")
    cat.store(prints, meta)
    files = lambda: sorted(p.name for p in (tmp_path / "cat" / str(cat.generation()) / "added").glob("*.parquet"))
    assert len(files()) == 3
    was = files()
    cat.load(prints, meta)
    assert files() == was and cat.metadata().count() == 2
    cat.delete(spark.createDataFrame([(2,)], "resource_id long"))
    cat.compact()
    rows = cat.fingerprints().collect()
    assert {r.resource_id for r in rows} == {1} and len(rows) == 40  # 2 was deleted, 3 never had metadata
    cat.load(prints, meta)
    assert {r.resource_id for r in cat.fingerprints().collect()} == {1, 2} and cat.fingerprints().count() == 80
