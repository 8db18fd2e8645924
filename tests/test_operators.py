"""Operators on the small numeric cases of the inventory."""

import math
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from peakfold.config import Scan
from peakfold.functions import ident  # numeric cases below are fixed values
from peakfold.operators import align, duplicates, gates, lookup, monitor, pack, peaks
from peakfold.sources.catalog import Catalog, from_json


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def clusters(spark, spans, gap):
    df = spark.createDataFrame([("a", float(a), float(b), 1.0) for a, b in spans], "id string, start double, stop double, score double")
    return [r.hits for r in monitor.cluster_rows(monitor.clusters(df, gap)).orderBy("start").collect()]


@pytest.mark.parametrize(("spans", "sizes"), [
    ([(0, 30), (25, 55), (50, 80), (75, 105)], [4]), ([(1064, 1072), (1194, 1224), (1219, 1249), (1244, 1274), (1300, 1336)], [1, 4]),
    ([(0, 30), (60, 90)], [2]), ([(0, 30), (60.01, 90)], [1, 1]), ([(100, 130), (0, 30), (200, 230)], [1, 1, 1]),
])
def test_clusters(spark, spans, sizes):
    assert clusters(spark, spans, 30) == sizes


def test_effective_gap(spark):
    got = [one(spark, gates.effective_gap(30, F.lit(float(d)))) for d in (40, 200, -1, 0)]
    assert got == [20, 30, 30, 30]


def test_acceptance_uses_the_best_window(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 84.0, 0.6), ("a", 2.0, 3.0, 85.0, 0.2), ("b", 0.0, 1.0, 84.0, 0.4), ("b", 2.0, 3.0, 85.0, 0.2)], "id string, start double, stop double, score double, pct double")
    e = monitor.envelopes(df)
    assert [r.id for r in e.where(monitor.accepted(F.col("score"), F.col("best_pct"))).collect()] == ["a"]


def test_density_gate(spark):
    assert [one(spark, gates.hits_needed(F.lit(d))) for d in (14.9, 15.0, 200.0)] == [8, 20, 30]


def test_shift():
    assert Scan().shift == 1252


def test_windows(spark):
    df = spark.createDataFrame([(30,), (31,), (91,)], "total int")
    assert [r[0] for r in df.select(monitor.hops("total")).collect()] == [[], [0], [0, 20, 40, 60]]
    got = spark.createDataFrame([(305,)], "total int").select(monitor.sample_windows("total").alias("w")).first().w
    assert got[0] == 0 and got[-1] == 275 and max(b - a for a, b in zip(got, got[1:])) <= 30


def test_near_hash_attribution(spark):
    prints = spark.createDataFrame([(1, k, 2 * k - 300, k) for k in range(50)], "query_id long, pos long, hash long, t1 long")
    near = lookup.expand(prints)
    last = {}
    for k in range(50):
        for d in range(-2, 3):
            last[2 * k - 300 + d] = 2 * k - 300
    assert {r.near_hash: r.original_hash for r in near.collect()} == last
    index = spark.createDataFrame([(-300, 42, 5)], "hash long, resource_id long, t1 int")
    assert lookup.near_hits(prints, index).count() == 1
    assert lookup.near_hits(prints, index, avoid=spark.createDataFrame([(42,)], "resource_id long")).count() == 0


def test_impulse(spark):
    def run(v):
        return spark.createDataFrame([(v,)], "s array<float>").select(peaks.suppress_impulse(F.col("s")).alias("s")).first().s

    assert run([0.0, 1 / 32767, 0.0]) == [0, 0, 0]
    assert run([0.0, -1 / 32767, 0.0]) == [0, 0, 0]
    for v in ([1 / 32767, 1 / 32767, 0.0], [0.0, 2 / 32767], [0.0, 0.0], [float("inf"), 0.0]):
        assert run(v) == pytest.approx(v)


def test_same_query_time_gives_no_line(spark):
    hits = spark.createDataFrame([(1, 7, 5, k, 3, 0) for k in range(12)], "query_id long, near_hash long, original_hash long, match_time int, query_time int, resource_id long")
    assert align.align(hits).count() == 0


def test_alignment_of_a_shifted_copy(spark):
    hits = spark.createDataFrame([(1, k, k, 1000 + 10 * k, 10 * k, 7) for k in range(200)], "query_id long, near_hash long, original_hash long, match_time int, query_time int, resource_id long")
    r = align.align(hits).first()
    assert (r.resource_id, r.score, r.time_factor, r.ref_start) == (7, 200, 1.0, 8.0)


def test_duplicate_scan(spark):
    rows = []
    for k in range(100):
        t = 25 * k
        rows += [(k, 7, t), (k, 3, t + 2), (1000 + k, 9, t), (1000 + k, 7, t + 6250)]
    index = spark.createDataFrame(rows, "hash long, resource_id long, t1 int")
    catalog = spark.createDataFrame([(i, 20.0) for i in (3, 7, 9)], "resource_id long, duration double")
    got = duplicates.scan(index, catalog, Scan(min_similarity=0.1)).collect()
    assert [(r.a, r.b) for r in got] == [(3, 7)]
    assert got[0].coverage_a == 1.0 and abs(got[0].offset_seconds + 0.016) <= 0.02


def test_groups(spark):
    pairs = spark.createDataFrame([(10, 20, 0.99, 0.98), (20, 30, 0.97, 0.96), (40, 50, 0.70, 0.68)], "a long, b long, coverage_a double, coverage_b double")
    g = duplicates.components(pairs)
    assert {r.id: r.component for r in g.collect()} == {10: 10, 20: 10, 30: 10, 40: 40, 50: 40}
    m = {r.id: r for r in duplicates.member_similarity(pairs, g).collect()}
    assert m[20].mean_similarity == pytest.approx(0.97) and m[10].mean_similarity == pytest.approx(0.49)
    catalog = spark.createDataFrame([(10, 1.0, 1), (20, 1.0, 1), (30, 1.0, 1), (40, 197.0, 13000), (50, 204.0, 13000)], "resource_id long, duration double, num_fingerprints long")
    keep = lambda c: {r.component: r.keep for r in duplicates.recommend(duplicates.member_similarity(pairs, g), c).collect()}
    assert keep(catalog) == {10: 20, 40: 40}
    assert keep(catalog.where("resource_id <> 20"))[10] == 10


def test_keep_is_by_hundredths_as_doubles_round(spark):
    """0.575 is a little less than that, so it is 0.57 as in SQL, and the denser one of equals stays."""
    members = spark.createDataFrame([(1, 1, 0.575), (2, 1, 0.57), (3, 2, 0.675), (4, 2, 0.67)], "id long, component long, mean_similarity double")
    catalog = spark.createDataFrame([(1, 10.0, 80), (2, 10.0, 90), (3, 10.0, 80), (4, 10.0, 90)], "resource_id long, duration double, num_fingerprints long")
    assert {r.component: r.keep for r in duplicates.recommend(members, catalog).collect()} == {1: 2, 2: 3}


def test_mean_similarity_is_that_of_the_exact_sum(spark):
    """Two members with the same similarities, which arrive in opposite orders; sums of doubles differ by these."""
    s = [0.56, 0.7, 0.51, 0.51, 0.51, 0.91, 0.84]
    assert reduce(add, s) != reduce(add, reversed(s))
    rows = [(1, 10 + k, x, 1.0) for k, x in enumerate(s)] + [(2, 10 + k, x, 1.0) for k, x in reversed(list(enumerate(s)))]
    pairs = spark.createDataFrame(rows, "a long, b long, coverage_a double, coverage_b double").coalesce(1)
    groups = spark.createDataFrame([(1, 1), (2, 1), *((10 + k, 1) for k in range(len(s)))], "id long, component long")
    m = {r.id: r.mean_similarity for r in duplicates.member_similarity(pairs, groups).collect()}
    assert m[1] == m[2] == math.fsum(s) / 8


def murmur(data: bytes) -> int:
    mask, h = 0xFFFFFFFF, 0
    scramble = lambda k: ((k := k * 0xCC9E2D51 & mask) << 15 | k >> 17) * 0x1B873593 & mask
    n = len(data) // 4
    for i in range(n):
        h ^= scramble(int.from_bytes(data[4 * i : 4 * i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 & mask) + 0xE6546B64 & mask
    if data[4 * n :]:
        h ^= scramble(int.from_bytes(data[4 * n :], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def test_murmur(spark):
    texts = ["", "a", "ab", "abc", "abcd", "hello, world", "éèß", "x" * 37]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ident.murmur3_32(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: murmur(t.encode()) for t in texts}


def test_names_and_urls(spark):
    assert one(spark, ident.stem(F.lit("a/b\\US12.x.mp3"))) == "US12.x"
    assert one(spark, ident.stem(F.lit(".hidden"))) == ".hidden"
    assert one(spark, ident.resource_id(F.lit("/m/123.mp3"))) == 123
    assert one(spark, ident.resource_id(F.lit("/m/abc.mp3"))) == (2**31 - 1) // 2 + abs(murmur(b"abc")) // 2
    assert one(spark, ident.url_file_name(F.lit("https://h/a/b.mp3?x=/y"))) == "b.mp3"
    assert one(spark, ident.url_file_name(F.lit("https://h/"))) is None
    assert one(spark, ident.redacted_url(F.lit("https://u:p@h/a?b#c"))) == "https://h/a"
    move = lambda u, host="cdn.x", origin="https://o.x/base/": one(spark, ident.to_origin(F.lit(u), host, origin))
    assert move("https://CDN.x/a/b.mp3?q=1") == "https://o.x/base/a/b.mp3?q=1"
    assert move("https://cdn.x/base/b.mp3") == "https://o.x/base/b.mp3"
    assert move("https://cdn.xx/b.mp3") == "https://cdn.xx/b.mp3"
    assert move("https://cdn.x/b.mp3", " ") == "https://cdn.x/b.mp3"


def test_segments(spark):
    got = one(spark, ident.segments(F.lit('{"segments":[{"start_seconds":0,"end_seconds":5},{"start_seconds":5,"end_seconds":5},{"start_seconds":-1,"end_seconds":5}]}')))
    assert [(s.start_seconds, s.end_seconds) for s in got] == [(0, 5)]


def test_hash_layout(spark):
    p = spark.createDataFrame([(1, 0, 100, 3.0), (1, 10, 110, 2.0), (1, 30, 90, 1.0)], "resource_id long, t int, f int, m double")
    r = pack.triples(p).select(pack.duration_hash().alias("h")).first().h
    flags = sum(b << k for k, b in enumerate([0, 1, 0, 1, 1, 0, 0, 0], 6))
    assert r == 30 + flags + (50 << 14) + (2 << 22) + (5 << 28)


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    prints = spark.createDataFrame([(5, 1, 0), (6, 1, 1), (5, 2, 0)], "hash long, resource_id long, t1 int")
    meta = spark.createDataFrame([(1, "a.mp3", 2.0, 2), (2, "b.mp3", 1.0, 1)], "resource_id long, path string, duration double, num_fingerprints long")
    cat.store(prints, meta)
    cat.load(prints, meta)
    assert cat.fingerprints().count() == 3 and cat.metadata().count() == 2
    assert cat.rename(1, "c.mp3") and not cat.rename(77, "x")
    assert {r.resource_id: r.path for r in cat.metadata().collect()} == {1: "c.mp3", 2: "b.mp3"}
    ids = spark.createDataFrame([(1,), (77,)], "resource_id long")
    assert {r.resource_id: r.fingerprints_deleted for r in cat.delete(ids).collect()} == {1: 2, 77: 0}
    assert [r.resource_id for r in cat.metadata().collect()] == [2] and cat.fingerprints().count() == 3
    cat.compact()
    assert cat.fingerprints().count() == 1
    cat.clear()
    assert cat.metadata().count() == 0


def test_json_ingest(spark):
    df = spark.createDataFrame([('{"identifier":3,"filename":"x","duration":1.5,"fingerprints":[{"hash":1,"t1":2},{"hash":-1,"t1":2},{"t1":4}]}',), ("broken",)], "value string")
    assert [(r.identifier, r.hash, r.t1) for r in from_json(df).collect()] == [(3, 1, 2)]


def test_store_stream(spark, tmp_path):
    from peakfold.streaming.worker import MESSAGE, store_batch

    (tmp_path / "in").mkdir()
    import json

    body = {"identifier": 3, "filename": "x", "duration": 1.5, "fingerprints": [{"hash": 1, "t1": 2}]}
    for k, v in enumerate([json.dumps(body), json.dumps(body), "{}"]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"key": f"k{k}", "value": v}))
    cat, out = Catalog(spark, str(tmp_path / "cat")), []
    q = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).writeStream.foreachBatch(store_batch(cat, lambda r: out.extend(r.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.status for r in out) == ["already_exists", "error", "ok"] and cat.fingerprints().count() == 1
