"""Results of duplicate scans and the log of deletions, as tables of a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.session import remove

SCANS = "scan_id string, started_at timestamp, finished_at timestamp, pairs long"
DELETIONS = "deleted_at timestamp, scan_id string, keep long, keep_stem string, resource_id long, stem string, similarity double, verified_on string, fingerprints_deleted long"


def latest_scan(scans: DataFrame) -> DataFrame:
    """The one scan that ended last; of equals the greatest id."""
    return scans.where("finished_at is not null").orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(1)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 10_000) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit is from 1 to {most}, offset not below 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


class ScanStore:
    """Pairs and tracks of the last scan, each scan in folders of its own; its row in ``scans`` is written last
    and publishes it, then older scans' folders go. Deletions are only added."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}") if there else self.spark.createDataFrame([], schema)

    def scans(self) -> DataFrame:
        return self._read("scans", SCANS)

    def latest(self):
        return latest_scan(self.scans()).first()

    def save(self, scan_id: str, pairs: DataFrame, tracks: DataFrame) -> None:
        started = self.spark.sql("select current_timestamp() as t").first().t
        older = [r.scan_id for r in self.scans().select("scan_id").distinct().collect()]  # two at most, as older ones are gone
        pairs.write.mode("overwrite").parquet(f"{self.base}/pairs-{scan_id}")
        tracks.write.mode("overwrite").parquet(f"{self.base}/tracks-{scan_id}")
        n = self.spark.read.parquet(f"{self.base}/pairs-{scan_id}").count()
        row = self.spark.createDataFrame([(scan_id, started, n)], "scan_id string, started_at timestamp, pairs long")
        row.select("scan_id", "started_at", F.current_timestamp().alias("finished_at"), "pairs").write.mode("append").parquet(f"{self.base}/scans")
        for old in older:
            if old != scan_id:
                remove(self.spark, f"{self.base}/pairs-{old}")
                remove(self.spark, f"{self.base}/tracks-{old}")

    def pairs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/pairs-{self.latest().scan_id}")

    def tracks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/tracks-{self.latest().scan_id}")

    def complete(self) -> bool:
        """Whether all pairs that the scan's row tells of are there."""
        row = self.latest()
        return row is not None and self.pairs().count() >= row.pairs

    def log_deletions(self, rows: DataFrame) -> None:
        rows.select(*(c.split(" ")[0] for c in DELETIONS.split(", "))).write.mode("append").parquet(f"{self.base}/deletions")

    def deletions(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return page(self._read("deletions", DELETIONS), [F.desc("deleted_at"), "resource_id"], limit, offset)
