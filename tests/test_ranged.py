"""Scans by ranges: bounds, going on after a stop, and new resources only."""

import random

import pytest
from pyspark.sql import functions as F

from peakfold.config import Scan
from peakfold.operators import duplicates, ranged

P = Scan(frames_per_second=10.0, max_offset_frames=100, min_similarity=0.3)
PAIRS = "a long, b long, offset_seconds double, aligned_hits long, coverage_a double, coverage_b double"


@pytest.fixture(scope="module")
def index(spark):
    """Groups of resources with shared hashes at an offset, and one hash that all have."""
    rng = random.Random(4)
    rows = []
    for r in range(60):
        base = 100_000 * (r // 3)
        rows += [(base + 17 * t, r, t + r % 3) for t in range(200) if rng.random() < 0.9] + [(5_000_000 + r, r, 3)]
    rows += [(9_999_999, r % 60, r) for r in range(300)]
    return spark.createDataFrame(rows, "hash long, resource_id long, t1 int").repartition(4)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(r, 20.0 + r % 3) for r in range(60)], "resource_id long, duration double")


def rows_of(df):
    return sorted(map(tuple, df.select("a", "b", F.round("offset_seconds", 6), "aligned_hits", F.round("coverage_a", 9), F.round("coverage_b", 9)).collect()))


def test_bounds_cover_all_hashes_evenly(index):
    rows = ranged.range_bounds(index, 1000).orderBy("part").collect()
    total = index.count()
    assert sum(r.n for r in rows) == total and len(rows) >= total // 1000
    assert all(x.high < y.low for x, y in zip(rows, rows[1:])) and all(r.n <= 2000 for r in rows)
    for r in rows:
        assert index.where(F.col("hash").between(r.low, r.high)).count() == r.n
    assert ranged.range_bounds(index.limit(0)).count() == 0
    (one,) = ranged.range_bounds(index).collect()
    assert one.n == total


def test_a_stopped_scan_goes_on(spark, index, catalog, tmp_path, monkeypatch):
    want = rows_of(duplicates.scan(index, catalog, P))
    assert len(want) == 60
    base = str(tmp_path / "scan")
    assert ranged.RangedScan(spark, base, P, 1500).run(index, catalog, stop_after=3) is None
    seen = ranged.RangedScan(spark, base, P, 1500).progress()
    assert seen["done"] == [0, 1, 2] and seen["ranges"] > 3 and not seen["finished"]
    made = []
    plain = ranged.RangedScan._range

    def broken(self, b, *rest):
        made.append(b["part"])
        if len(made) == 3:
            self._write(self.spark.range(3), f"counts/{b['part']}")  # half a range, without its mark
            raise OSError("lost")
        plain(self, b, *rest)

    monkeypatch.setattr(ranged.RangedScan, "_range", broken)
    with pytest.raises(OSError):
        ranged.RangedScan(spark, base, P, 1500).run(index, catalog)
    monkeypatch.setattr(ranged.RangedScan, "_range", lambda self, b, *rest: (made.append(b["part"]), plain(self, b, *rest)))
    again = ranged.RangedScan(spark, base, P, 1500)
    assert rows_of(again.run(index, catalog)) == want
    assert made[:3] == [3, 4, 5] and made[3:] == list(range(5, seen["ranges"]))
    assert again.progress()["finished"] and rows_of(again.run(index.limit(0), catalog)) == want  # what is done isn't done again
    assert sorted(map(tuple, again.tracks().collect())) == sorted(map(tuple, duplicates.tracks(index, P).collect()))


def test_ranges_are_made_together_and_go_on_as_a_whole(spark, index, catalog, tmp_path, monkeypatch):
    """Jobs follow the rows and not the number of ranges; what was cut off, its mark not written, is made anew."""
    base, made, plain = str(tmp_path / "together"), [], ranged.RangedScan._range
    monkeypatch.setattr(ranged.RangedScan, "_range", lambda self, b, *rest: (made.append((b["part"], b["last"])), plain(self, b, *rest)))
    scan = lambda: ranged.RangedScan(spark, base, P, 500, 5000)
    assert scan().run(index, catalog, stop_after=2) is None and made == [(0, 1)] and scan().progress()["done"] == [0, 1]
    mark = ranged.RangedScan._mark
    monkeypatch.setattr(ranged.RangedScan, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        scan().run(index, catalog)
    monkeypatch.setattr(ranged.RangedScan, "_mark", mark)
    assert rows_of(scan().run(index, catalog)) == rows_of(duplicates.scan(index, catalog, P))
    total = scan().progress()["ranges"]
    assert made[1] == made[2] and made[1][0] == 2 and made[-1][1] == total - 1 and len(made) < total / 2
    assert scan().progress()["done"] == list(range(total))


def test_new_resources_against_all(spark, index, catalog, tmp_path):
    new = spark.createDataFrame([(3,), (4,), (10,), (59,)], "resource_id long")
    all_ = duplicates.scan(index, catalog, P)
    ids = {3, 4, 10, 59}
    want = [r for r in rows_of(all_) if r[0] in ids or r[1] in ids]
    assert rows_of(duplicates.scan(index, catalog, P, new)) == want and len(want) == 7
    assert rows_of(ranged.RangedScan(spark, str(tmp_path / "new"), P, 1500).run(index, catalog, new)) == want
    old = duplicates.scan(index.join(new, "resource_id", "left_anti"), catalog, P)
    assert rows_of(duplicates.updated(old, duplicates.scan(index, catalog, P, new), new)) == rows_of(all_)


def test_no_rows(spark, index, catalog, tmp_path):
    assert ranged.RangedScan(spark, str(tmp_path / "none"), P).run(index.limit(0), catalog).count() == 0


def test_only_pairs_that_can_be_similar_are_met_again(spark):
    near = spark.createDataFrame([(1, 2, 5, 5, 50), (1, 3, 5, 5, 20), (1, 3, 5, 6, 29)], "a long, b long, peak long, bucket long, hits long")
    track = spark.createDataFrame([(1, 100), (2, 80), (3, 10)], "resource_id long, eligible_seconds long")
    assert {(r.a, r.b) for r in duplicates.worth_it(near, track, 0.5).collect()} == {(1, 2)}
    assert {(r.a, r.b) for r in duplicates.worth_it(near, track, 0.49).collect()} == {(1, 2), (1, 3)}
