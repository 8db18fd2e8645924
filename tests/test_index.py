"""The index of documents and what a scan reads of it."""

import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from peakfold.config import Scan
from peakfold.operators import duplicates
from peakfold.plans import adapters as ad
from peakfold.plans import queries

TEXTS = [None, "", "a", "a b", "a b c", " a  b ", "A b C d", "É ß\tx y\nz  w", "a b c a b c a b c", "x\u0000y z \U0001f600 \U0001f600 z"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(k, x, "en", "s", 0) for k, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return path


def expected():
    for k, x in enumerate(TEXTS):
        w = (x or "").lower().split(" ")
        for i in range(len(w) - 2):
            yield int(md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:8], 16), k, i


def test_index_of_odd_texts_knows_how_common_its_hashes_are(spark, folder):
    rows = sorted(tuple(r) for r in ad.counted_index(spark, folder).collect())
    assert [r[:3] for r in rows] == sorted(expected())
    for h, *_, n, lo, spread in rows:
        own = [r for r in rows if r[0] == h]
        assert n == len(own) and lo == min(r[1] for r in own) and spread == (len({r[1] for r in own}) > 1)
    assert ad.index(spark, folder).columns == ["hash", "resource_id", "t1"]


def test_eligible_rows_of_a_counted_index_need_no_join(spark, folder):
    p, rows = Scan(max_per_hash=3), ad.counted_index(spark, folder)
    found = duplicates.eligible_rows(rows, p)
    assert sorted(map(tuple, found.select("hash", "resource_id", "t1", "spread").collect())) == sorted(map(tuple, duplicates.eligible_rows(rows.drop("n", "lo", "spread"), p).select("hash", "resource_id", "t1", "spread").collect()))
    assert not re.search("Join|Exchange", found._jdf.queryExecution().executedPlan().toString())


def test_bitmaps_are_made_behind_the_exchange(spark):
    """Before it a task would hold a bitmap of each resource that its part of the index names."""
    rows = spark.range(100).select(F.col("id").alias("hash"), (F.col("id") % 7).alias("resource_id"), F.col("id").cast("int").alias("t1"))
    made = duplicates.track_seconds(rows, Scan(frames_per_second=10.0))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("bitmap_construct_agg") < plan.index("Exchange") and "bitmap_construct_agg" not in plan[plan.rindex("Exchange") :] and plan.count("Exchange") == 1
    assert {r.resource_id: r.eligible_seconds for r in duplicates.counted(made, "resource_id").collect()} == {k: len({t // 10 for t in range(100) if t % 7 == k}) for k in range(7)}


@pytest.mark.parametrize("piece", [1, 7, 50_000])
def test_pairs_meet_once_at_each_offset(spark, monkeypatch, piece):
    """As a loop over all pairs, whatever the pieces in which hashes come; rows with and without their hash's least resource."""
    monkeypatch.setattr(duplicates, "MEET", piece)
    monkeypatch.setattr(duplicates, "GIVE", piece)
    p = Scan(frames_per_second=10.0, max_offset_frames=8, max_duration_difference=3.0)
    data = [(k * k % 5, k * 7 % 6, k * 13 % 29, float(k * 7 % 6)) for k in range(60)]
    least = {h: min(r[1] for r in data if r[0] == h) for h, *_ in data}
    want = {}
    for new in (None, [2, 3]):
        want[new is None] = sorted(
            (x[1], y[1], (y[2] - x[2] + p.shift) // p.bucket, x[2] // 10, y[2] // 10)
            for x in data for y in data
            if x[0] == y[0] and x[1] < y[1] and abs(x[2] - y[2]) <= 8 and abs(x[3] - y[3]) <= 3 and (new is None or x[1] in new or y[1] in new)
        )
        rows = spark.createDataFrame([(*r, least[r[0]]) for r in data], "hash long, resource_id long, t1 int, duration double, lo long")
        fresh = None if new is None else spark.createDataFrame([(k,) for k in new], "resource_id long")
        for each in (rows, rows.drop("lo")):
            assert sorted(map(tuple, duplicates.raw_pairs(each, p, fresh, 3).collect())) == want[new is None]
    assert 0 < len(want[False]) < len(want[True])


def test_rows_meet_by_one_exchange_and_no_join(spark):
    rows = spark.range(10).selectExpr("id as hash", "id as resource_id", "cast(id as int) as t1", "1.0D as duration", "id as lo")
    plan = duplicates.raw_pairs(rows, Scan())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_document_prints_are_the_index_by_document(spark, folder):
    """JSON requests are made of them, a row each, with nothing gathered."""
    rows = ad.document_prints(spark, folder).select("resource_id", F.explode("prints").alias("p")).select("p.hash", "resource_id", "p.t1")
    assert sorted(map(tuple, rows.collect())) == sorted(expected())
    plan = queries.QUERIES["a25_json_ingest"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "documents.parquet" in plan
