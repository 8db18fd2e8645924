"""A duplicate scan by ranges of hashes, which goes on where it stopped.

A hash is in one range with all its rows, so each range's counts of hits, rows and seconds are found on
their own and added up at the end. A range's tables are there once its mark is; what was cut off before is
made anew. Bounds are kept with the scan, so that it goes on with the same ones whatever is stored since.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold.config import Scan
from peakfold.operators import duplicates
from peakfold.session import remove

#: Rows that a range is to have; cells between the least and the greatest hash, of which ranges are made.
RANGE_ROWS, CELLS = 20_000_000, 65_536


def cells(index: DataFrame, most: int = CELLS) -> tuple[DataFrame, int, int]:
    """((cell, n), least hash, width): how many rows have a hash in each cell of equal width."""
    low, high = index.agg(F.min("hash"), F.max("hash")).first()
    low, width = (0, 1) if low is None else (low, -(-(high - low + 1) // most))
    return index.groupBy(F.expr(f"(hash - ({low})) div {width}").alias("cell")).agg(F.count("*").alias("n")), low, width


def range_bounds(index: DataFrame, rows: int = RANGE_ROWS, most: int = CELLS) -> DataFrame:
    """(part, low, high, n): ranges of hashes, both ends included, with about ``rows`` rows each; a cell isn't cut, so a
    hash that has more than that many is in a range with its cell alone at worst. Exact but for the cells' width."""
    counted, low, width = cells(index, most)
    before = F.sum("n").over(Window.orderBy("cell")) - F.col("n")  # one row a cell, so a bounded number
    parts = counted.withColumn("part", F.floor(before / rows).cast("int")).groupBy("part").agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.sum("n").alias("n"))
    return parts.select("part", (F.col("a") * width + low).alias("low"), ((F.col("b") + 1) * width + low - 1).alias("high"), "n")


class RangedScan:
    """A scan in a shared folder. run() does what is left and gives the pairs; new: only pairs with one of these resources.

    at_once: neighbouring ranges are made together as far as they have that many rows in all, a range at least. They have
    the tables and the mark of the first one, which names the last one too, so they are there or not as a whole."""

    def __init__(self, spark: SparkSession, base: str, p: Scan = Scan(), range_rows: int = RANGE_ROWS, at_once: int = 0):
        self.spark, self.base, self.p, self.range_rows, self.at_once = spark, base.rstrip("/"), p, range_rows, at_once

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, name: str) -> bool:
        fs, at = self._path(name)
        return fs.exists(at)

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def bounds(self, index: DataFrame) -> list:
        """Made once. A row a range; there are as many as the index has times RANGE_ROWS rows."""
        if not self._there("bounds/_SUCCESS"):
            self._write(range_bounds(index, self.range_rows).coalesce(1), "bounds")
        return self._read("bounds").orderBy("part").collect()

    def _made(self) -> list[tuple[int, int]]:
        """First and last range of what was made together, by the names of marks."""
        fs, at = self._path("done")
        names = [f.getPath().getName().split("-") for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n[0]), int(n[-1])) for n in names)

    def _mark(self, part: int, rows: int, last: int | None = None) -> None:
        fs, at = self._path(f"done/{part}" if last in (None, part) else f"done/{part}-{last}")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"part": part, "rows": rows}).encode()))
        out.close()

    def progress(self) -> dict:
        """Ranges in all and those done; the latter are never computed again."""
        total = self._read("bounds").count() if self._there("bounds/_SUCCESS") else None
        done = [k for first, last in self._made() for k in range(first, last + 1)]
        return {"ranges": total, "done": done, "finished": self._there("pairs/_SUCCESS")}

    def _together(self, left: list) -> list[dict]:
        """What is to be made at a time: neighbouring ranges with at_once rows in all."""
        out: list[dict] = []
        for b in left:
            one = {"part": b["part"], "low": b["low"], "high": b["high"], "n": b["n"], "last": b["part"]}
            if out and one["part"] == out[-1]["last"] + 1 and out[-1]["n"] + one["n"] <= self.at_once:
                out[-1] |= {"high": one["high"], "last": one["last"], "n": out[-1]["n"] + one["n"]}
            else:
                out.append(one)
        return out

    def _range(self, b, index: DataFrame, catalog: DataFrame, new: DataFrame | None) -> None:
        """The tables of ranges that are made together: eligible rows that can meet, hits by bucket, rows and seconds of tracks."""
        low_high = index.where(F.col("hash").between(b["low"], b["high"]))  # reaches the scan of a sorted index
        rows = duplicates.eligible_rows(low_high, self.p)
        self._write(duplicates.shared(low_high, catalog, self.p, rows), f"rows/{b['part']}")
        met = self._read(f"rows/{b['part']}")
        tasks = duplicates.tasks_of(met) if b["n"] > duplicates.TASK_ROWS else None
        self._write(duplicates.hit_counts(duplicates.raw_pairs(met, self.p, new, tasks)), f"counts/{b['part']}")
        self._write(duplicates.track_seconds(rows, self.p), f"seconds/{b['part']}")
        self._write(low_high.groupBy("resource_id").agg(F.count("*").alias("fingerprints")), f"sizes/{b['part']}")
        self._mark(b["part"], b["n"], b["last"])

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.base}/{name}/{first}" for first, _ in self._made()))

    def run(self, index: DataFrame, catalog: DataFrame, new: DataFrame | None = None, stop_after: int | None = None) -> DataFrame | None:
        """The pairs; None where stop_after ranges of this run are done and others are left."""
        if not self._there("pairs/_SUCCESS"):
            bounds = self.bounds(index)
            done = set(self.progress()["done"])
            left = [b for b in bounds if b["part"] not in done]
            for b in self._together(left[:stop_after]):
                self._range(b, index, catalog, new)
            if stop_after is not None and len(left) > stop_after:
                return None
            self._merge(bounds, new)
        return self._read("pairs")

    def _merge(self, bounds: list, new: DataFrame | None) -> None:
        """Sums of the ranges' hits, and their seconds' bitmaps united; then scores as of a scan in one piece."""
        if not bounds:
            none = self.spark.createDataFrame([], "a long, b long, offset_seconds double, aligned_hits long, coverage_a double, coverage_b double")
            self._write(self.spark.createDataFrame([], "resource_id long, fingerprints long, eligible_seconds long"), "tracks")
            self._write(none, "pairs")
            return
        self._write(self._all("seconds").groupBy("resource_id", "number").agg(F.bitmap_or_agg("bits").alias("bits")), "all-seconds")
        seconds = self._read("all-seconds")
        sizes = self._all("sizes").groupBy("resource_id").agg(F.sum("fingerprints").alias("fingerprints"))
        known = duplicates.counted(seconds, "resource_id")
        self._write(sizes.join(known, "resource_id", "left").select("resource_id", "fingerprints", F.coalesce("eligible_seconds", F.lit(0).cast("long")).alias("eligible_seconds")), "tracks")
        counts = self._all("counts").groupBy("a", "b", "bucket").agg(F.sum("hits").alias("hits"))
        self._write(duplicates.scored(self._all("rows"), counts, seconds, self.p, new=new), "pairs")
        for name in ("rows", "counts", "seconds", "sizes", "all-seconds"):
            remove(self.spark, f"{self.base}/{name}")

    def tracks(self) -> DataFrame:
        return self._read("tracks")
