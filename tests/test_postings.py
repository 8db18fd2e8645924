"""Posting lists against the row-wise lookup; what they shuffle; what the two-phase search leaves out."""

import re

import pytest
from pyspark.sql import functions as F

from peakfold.operators import align, lookup
from peakfold.sources.postings import Postings

HITS = ["query_id", "original_hash", "near_hash", "resource_id", "match_time", "query_time"]


def index_of(spark, hot_share=3, resources=120):
    """Resources of 30 hashes; one hash is in a third of all, another in each; pairs of copies."""
    rows = []
    for r in range(resources):
        base = (r // 2) * 1000
        rows += [(base + 7 * k, r, 3 * k + (r % 2) * 5, k) for k in range(24)]
        rows += [(50_000_000, r, 90, 1)] + ([(60_000_000, r, 91, 1), (60_000_000, r, 92, 2)] if r % hot_share == 0 else [])
    return spark.createDataFrame(rows, "hash long, resource_id long, t1 int, f1 int")


def asked_of(index, every=6):
    return index.where(F.col("resource_id") % every == 0).select(F.col("resource_id").alias("query_id"), F.col("t1").cast("long").alias("pos"), "hash", "t1", "f1")


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    return Postings.build(index_of(spark), str(tmp_path_factory.mktemp("postings")), longest=8, buckets=4)


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_lists_hold_the_index_in_bounded_parts(spark, lists):
    index = index_of(spark)
    back = lists.lists().select("hash", "part", F.explode("entries").alias("e")).select("hash", "part", "e.resource_id", F.explode("e.at").alias("x"))
    assert rows_of(back.select("hash", "resource_id", "x.t1", "x.f1"), ["hash", "resource_id", "t1", "f1"]) == rows_of(index, ["hash", "resource_id", "t1", "f1"])
    assert lists.lists().agg(F.max(F.size("entries"))).first()[0] <= 16  # of 120 resources with one hash
    words = {r.hash: (r.n, r.most) for r in lists.dictionary().collect()}
    assert words[50_000_000] == (120, 1) and words[60_000_000] == (80, 2) and words[7] == (2, 1)


def test_salted_lists_are_the_same(spark, lists, tmp_path, monkeypatch):
    monkeypatch.setattr("peakfold.sources.postings.MOST_BROADCAST", 0)
    other = Postings.build(index_of(spark), str(tmp_path), longest=8, buckets=4)
    assert rows_of(other.lists(), ["hash", "part", "entries"]) == rows_of(lists.lists(), ["hash", "part", "entries"])


@pytest.mark.parametrize("attribution", ["last", "all"])
def test_lookup_equals_rows(spark, lists, attribution):
    index, more = index_of(spark), [*HITS, "match_f1", "query_f1"]
    asked = asked_of(index)
    assert rows_of(lookup.near_hits(asked, lists, attribution=attribution), more) == rows_of(lookup.near_hits(asked, index, attribution=attribution), more)


def test_avoidance_and_targets(spark, lists):
    index = index_of(spark)
    asked = asked_of(index)
    some = spark.createDataFrame([(r,) for r in range(0, 120, 5)], "resource_id long")
    group = asked.select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("resource_id")).distinct()
    for kind in ({"avoid": some}, {"avoid": group}, {"targets": group}):
        got, want = (rows_of(lookup.near_hits(asked, x, **kind), HITS) for x in (lists, index))
        assert got == want
    own = lookup.near_hits(asked, index, avoid=group)
    assert own.where("resource_id - query_id in (0, 1)").isEmpty() and not own.isEmpty()


def test_search_keeps_all_frequent_pairs(spark, lists):
    index = index_of(spark)
    asked = asked_of(index)
    pair = ["query_id", "resource_id"]
    every = lookup.near_hits(asked, index)
    enough = every.groupBy(*pair).count().where("count >= 10").select(*pair)
    found = lists.search(asked, 10, few=0)
    assert rows_of(found.join(enough, pair, "left_semi"), HITS) == rows_of(every.join(enough, pair, "left_semi"), HITS)
    _, candidates = lists.candidates(asked, 10)
    assert candidates.count() == enough.count() == 40  # of 20 queries against 120 resources that all share a hash
    assert every.count() > 2 * found.count()
    group = asked.select("query_id", F.col("query_id").alias("resource_id")).distinct()
    for few in (0, 10**9):
        assert rows_of(align.align(lists.search(asked, 10, avoid=group, few=few)), pair) == rows_of(align.align(lookup.near_hits(asked, index, avoid=group)), pair)
    assert lists.search(asked, 10).count() == every.count()  # few enough to make them all


@pytest.mark.parametrize("few", [None, 0])
def test_search_gives_a_pair_to_one_of_as_many_tasks_as_hits_ask_for(spark, lists, few, monkeypatch):
    monkeypatch.setattr("peakfold.sources.postings.TASK_HITS", 100)
    asked = asked_of(index_of(spark))
    found = lists.search(asked, 10, few=few, together=True)
    assert rows_of(found, HITS) == rows_of(lists.search(asked, 10, few=few), HITS)
    assert found.rdd.getNumPartitions() >= found.count() / 100 > 4  # of 4 shuffle partitions
    placed = found.select("query_id", "resource_id", F.spark_partition_id().alias("p")).groupBy("query_id", "resource_id").agg(F.countDistinct("p").alias("n"))
    assert placed.agg(F.max("n")).first()[0] == 1
    plan = align.parts(found)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+L?, resource_id#\d+L?, ", plan.split("== Initial Plan ==")[-1])) == len(re.findall(r"Exchange hashpartitioning\(query_id#\d+L?, resource_id#\d+L?, ", found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]))


def ancestors(plan: str, marker: str):
    """Operators above the scan that has the marker, nearest first."""
    depth = lambda line: len(re.match(r"[\s:|+\-*()\d]*", line)[0])
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if marker in line)
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            out.append(line.strip(" :|+-*()0123456789"))
    return out


def test_lookup_shuffles_the_query_alone(spark, lists):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lists.near_hits(asked_of(index_of(spark)))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for table in ("_lists", "_dictionary"):
        above = ancestors(plan, table)
        join = next(k for k, x in enumerate(above) if "Join" in x)
        assert not any("Exchange" in x for x in above[:join]), above[:join]
    assert "Bucketed: true" in plan


def test_joins_hold_lists_and_not_the_pairs_that_ask_for_them(spark, lists):
    """A merge join keeps a key's rows of its right side in memory; a list may be asked for by any number of pairs."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = asked_of(index_of(spark))
        group = asked.select("query_id", F.col("query_id").alias("resource_id")).distinct()
        targeted, searched = (x._jdf.queryExecution().executedPlan().toString() for x in (lists.near_hits(asked, targets=group), lists.search(asked, 10, few=0)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    join = next(k for k, x in enumerate(targeted.splitlines()) if "SortMergeJoin [near_hash" in x and "part#" in x)
    left = targeted.splitlines()[join + 1 :]
    right = next(k for k, x in enumerate(left) if x.find("+- ") == left[0].find(":- "))
    assert not any("_lists" in x for x in left[:right]) and any("_lists" in x for x in left[right:])
    assert re.search(r"SortMergeJoin \[near_hash#\d+L, resource_id#\d+L\]", searched) and "lambdafunction" not in searched  # no list is gone through for each pair


def test_catalog_reads_lists_and_what_came_after(spark, tmp_path):
    from peakfold.sources.catalog import Catalog, Index

    index = index_of(spark)
    meta = spark.createDataFrame([(r, f"{r}.mp3", 30.0, 25) for r in range(120)], "resource_id long, path string, duration double, num_fingerprints long")
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.store(index.where("resource_id < 80"), meta.where("resource_id < 80"))
    assert not isinstance(cat.index(), Index)
    cat.compact(lists=True)
    cat.store(index.where("resource_id >= 80"), meta.where("resource_id >= 80"))
    gone = spark.createDataFrame([(1,), (91,)], "resource_id long")
    cat.delete(gone)
    live = index.join(gone, "resource_id", "left_anti")
    asked = asked_of(index, 5)
    name = cat.index().lists.name
    for known in (True, False):
        if not known:  # as in another session
            for table in ("lists", "dictionary"):
                spark.sql(f"DROP TABLE {name}_{table}")
        found = cat.index()
        assert isinstance(found, Index) and rows_of(lookup.near_hits(asked, found), [*HITS, "match_f1"]) == rows_of(lookup.near_hits(asked, live), [*HITS, "match_f1"])
        assert rows_of(align.align(lookup.frequent_hits(asked, found, 10)), ["query_id", "resource_id", "score"]) == rows_of(align.align(lookup.near_hits(asked, live)), ["query_id", "resource_id", "score"])
    assert "bucket" in spark.sql(f"DESCRIBE EXTENDED {name}_lists").where("col_name = 'Num Buckets'").first().col_name.lower()
    cat.compact()
    assert not isinstance(cat.index(), Index) and cat.fingerprints().count() == live.count()


def test_known_counts_need_no_pass(spark, tmp_path, monkeypatch):
    """An index that tells how many rows each hash has is dealt out once, and gives the same lists."""
    from peakfold.sources import postings

    index = index_of(spark)
    plain = Postings.build(index, str(tmp_path / "a"), longest=8, buckets=4)
    monkeypatch.setattr(postings, "written", lambda *a, **k: pytest.fail("hashes are counted again"))
    known = Postings.build(index.join(index.groupBy("hash").agg(F.count("*").alias("n")), "hash"), str(tmp_path / "b"), longest=8, buckets=4)
    for a, b in ((plain.lists(), known.lists()), (plain.dictionary(), known.dictionary())):
        assert a.columns == b.columns and rows_of(a, a.columns) == rows_of(b, b.columns)
    assert known.dictionary().agg(F.max("parts")).first()[0] > 1
