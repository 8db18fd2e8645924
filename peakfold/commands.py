"""What the engine does as a whole, by command, over a catalog in a shared folder.

    python -m peakfold.commands --base /shared/catalog stats

Prints come as Parquet with resource_id, hash, t1 (and f1); metadata as Parquet with resource_id, path,
duration, num_fingerprints (and title, audio_url). store-sound and query-sound read WAV files themselves.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold.config import Matching, Monitoring, Scan
from peakfold.functions.ident import metadata_text, resource_id
from peakfold.operators import align, duplicates, extract, gates, monitor
from peakfold.operators.ranged import RANGE_ROWS, RangedScan
from peakfold.session import remove, session, written
from peakfold.sources import scans
from peakfold.sources.catalog import Catalog, MemoryCatalog, complete, load_files, requested_ids, statistics
from peakfold.sources.results import listing_json, monitor_json
from peakfold.sources.textfiles import print_lines
from peakfold.strategies import strategy


class Engine:
    def __init__(self, spark: SparkSession, base: str, name: str = "exact", match: Matching = Matching()):
        self.spark, self.base, self.catalog, self.scans = spark, base.rstrip("/"), Catalog(spark, f"{base}/catalog"), scans.ScanStore(spark, f"{base}/scans")
        self.strategy, self.match = strategy(name), match

    def _live(self) -> tuple[DataFrame, DataFrame]:
        meta = self.catalog.metadata().where(complete())
        return self.catalog.fingerprints().join(meta.select("resource_id"), "resource_id", "left_semi"), meta

    def store(self, prints: DataFrame, meta: DataFrame) -> None:
        """Resources that are complete already stay as they are; those whose store was cut off are stored anew."""
        self.catalog.restore_incomplete(prints, meta)

    def heard(self, files: DataFrame, k: extract.Peaks = extract.Peaks()) -> tuple[DataFrame, DataFrame]:
        """files: path, content (WAV bytes). (prints, sound): sound has a row a file, with its id, length and error."""
        named = files.select("path", resource_id(F.col("path")).alias("resource_id"), "content")
        sound = extract.sound_files(named)
        chunks = extract.chunks_of_files(sound, k=k)
        prints = written(extract.prints(extract.triples(chunks, k=k)), "heard", keep=True)
        return prints, sound.select("resource_id", "seconds", "error").join(named.select("resource_id", "path"), "resource_id")

    def store_sound(self, files: DataFrame) -> DataFrame:
        """Stores files from their sound. (path, resource_id, status): error where a file can't be read, skipped_empty without
        prints, already_exists, or ok. Of files with the same id the first by path counts; the others are repeated."""
        prints, sound = self.heard(files)
        n = prints.groupBy("resource_id").agg(F.count("*").alias("num_fingerprints"))
        known = self.catalog.metadata().where(complete()).select("resource_id", F.lit(True).alias("known"))
        rows = sound.join(n, "resource_id", "left").join(known, "resource_id", "left").withColumn("first", F.row_number().over(Window.partitionBy("resource_id").orderBy("path")) == 1)
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("known"), "already_exists").when(~F.col("first"), "repeated").when(F.col("num_fingerprints").isNull(), "skipped_empty").otherwise("ok")
        out = written(rows.select("path", "resource_id", "seconds", "num_fingerprints", status.alias("status"), "error"), "stored", keep=True)
        ok = out.where("status = 'ok'")
        self.catalog.restore_incomplete(prints.join(ok.select("resource_id"), "resource_id", "left_semi"), ok.select("resource_id", "path", F.col("seconds").alias("duration"), "num_fingerprints"))
        return out.select("path", "resource_id", "status", "error")

    def query_sound(self, files: DataFrame, gated: bool = True) -> DataFrame:
        """The matches of files by their sound; query_id is a file's id."""
        prints, _ = self.heard(files)
        return self.query(prints.select(F.col("resource_id").alias("query_id"), F.col("t1").cast("long").alias("pos"), "hash", "t1"), gated)

    def deduplication(self, prints: DataFrame, near: DataFrame | None = None, gated: bool = True) -> DataFrame:
        """prints: query_id, pos, hash, t1 of stored resources, each under its own id. Matches other than itself, and
        than what near has for it (query_id, resource_id), such as the group it is known to be in."""
        own = prints.select("query_id", F.col("query_id").alias("resource_id")).distinct()
        avoid = own if near is None else own.union(near.select("query_id", "resource_id")).distinct()
        return self.query(prints, gated, avoid)

    def query(self, prints: DataFrame, gated: bool = True, avoid: DataFrame | None = None) -> DataFrame:
        """prints: query_id, pos, hash, t1. Best matches of each query; gated: only those of good quality, dense
        enough, and of resources that aren't shorter than the query. avoid: resource_id that don't count, or query_id
        and resource_id where each query has its own."""
        index, meta = self.catalog.index(), self.catalog.metadata().where(complete())
        found = align.ranked(self.strategy.query(prints, index, meta, self.match, avoid=avoid))
        if not gated:
            return found
        rows = found.join(meta.select("resource_id", "duration"), "resource_id", "left")
        return rows.where(gates.quality(F.col("score"), F.col("share")) & gates.density(F.col("score"), F.col("query_stop")) & gates.duration(F.col("query_stop"), F.col("duration"))).drop("duration")

    def monitor(self, prints: DataFrame, m: Monitoring = Monitoring()) -> DataFrame:
        """prints: recording, hash, t1. (recording, json) of the tracks in each recording."""
        index, meta = self.catalog.index(), self.catalog.metadata().where(complete())
        fps = 1 / self.match.seconds_per_frame
        recordings = prints.groupBy("recording").agg((F.max("t1") + 1).cast("long").alias("total"))
        rows = monitor.monitor(prints, recordings, index, meta.select("resource_id", (F.col("duration") * fps).alias("duration")), self.match, m)
        return monitor_json(monitor.tracks_of(rows, m, self.match.seconds_per_frame), meta)

    def same(self, a: DataFrame, b: DataFrame) -> float:
        """Share of one recording's prints (hash, t1) that lie on a line with the other's; 0 without a match."""
        memory = MemoryCatalog(b.withColumn("resource_id", F.lit(1).cast("long")), self.spark.createDataFrame([(1, "b", 1.0, 1)], "resource_id long, path string, duration double, num_fingerprints long"))
        asked = a.select(F.lit(0).cast("long").alias("query_id"), F.col("t1").cast("long").alias("pos"), "hash", "t1")
        best = self.strategy.query(asked, memory.fingerprints(), memory.metadata(), self.match).agg(F.max("score")).first()[0]
        return min(1.0, (best or 0) / max(1, a.count()))

    def scan(self, scan_id: str, p: Scan = Scan(), range_rows: int = RANGE_ROWS) -> int:
        """Finds and keeps all pairs of similar resources, by ranges of hashes; with an id of a scan that was cut off it goes on."""
        index, meta = self._live()
        work = RangedScan(self.spark, f"{self.base}/ranged-{scan_id}", p, range_rows)
        self.scans.save(scan_id, work.run(index, meta), work.tracks())
        remove(self.spark, work.base)
        return self.scans.latest().pairs

    def scan_new(self, scan_id: str, ids: DataFrame, p: Scan = Scan()) -> int:
        """Adds the pairs of new resources (resource_id) to those of the last scan; these alone are scanned against all."""
        index, meta = self._live()
        fresh = duplicates.scan(index, meta, p, ids)
        pairs = duplicates.updated(self.scans.pairs(), fresh, ids) if self.scans.latest() else fresh
        self.scans.save(scan_id, pairs, duplicates.tracks(index, p))
        return self.scans.latest().pairs

    def scan_progress(self, scan_id: str) -> dict:
        return RangedScan(self.spark, f"{self.base}/ranged-{scan_id}").progress()

    def duplicates(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of groups of duplicates among the resources that are still there, with the member to keep."""
        live = self.catalog.metadata().where(complete())
        ids = live.select("resource_id")
        pairs = self.scans.pairs().join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")
        groups = duplicates.components(pairs)
        keep = duplicates.recommend(duplicates.member_similarity(pairs, groups), live)
        if not 1 <= limit <= 1000 or offset < 0:
            raise ValueError("limit is from 1 to 1000, offset not below 0")
        return listing_json(duplicates.listing(pairs, groups, limit, offset), keep)

    def delete_duplicates(self, keep: int, others: list[int], least: float = 0.5, dry_run: bool = True, verify: bool = False) -> dict:
        """Deletes others as duplicates of keep if each is one, by the last scan or, with verify, by current rows; else nothing."""
        if not others or keep in others or len(set(others)) > 100:
            raise ValueError("1 to 100 ids other than the kept one")
        index, meta = self._live()
        known = {r.resource_id: r.path for r in meta.where(F.col("resource_id").isin([keep, *others])).select("resource_id", "path").collect()}
        if missing := {keep, *others} - set(known):
            raise LookupError(f"not found: {sorted(missing)}")
        if not verify and not self.scans.complete():
            raise LookupError("no finished scan; ask to verify or run one")
        asked = self.spark.createDataFrame([(keep, i) for i in sorted(set(others))], "keep long, other long")
        pairs = duplicates.verify(index, asked) if verify else self.scans.pairs()
        rows = duplicates.decided(duplicates.from_kept_side(pairs, asked), least).orderBy("other").collect()
        allowed = all(r.verified for r in rows)
        out = {"status": "rejected" if not allowed else "dry_run" if dry_run else "ok", "keep": keep, "tracks": [{"resource_id": r.other, "similarity": round(r.similarity, 3), "verified": r.verified} for r in rows]}
        if allowed and not dry_run:
            gone = {r.resource_id: r.fingerprints_deleted for r in self.catalog.delete(asked.select(F.col("other").alias("resource_id"))).collect()}
            scan = self.scans.latest()
            stem = lambda i: known[i].rsplit("/", 1)[-1].rsplit(".", 1)[0]
            on = "fingerprints" if verify else f"scan:{scan.scan_id}"
            log = self.spark.createDataFrame([(scan.scan_id if scan else None, keep, stem(keep), r.other, stem(r.other), float(r.similarity), on, gone.get(r.other, 0)) for r in rows], "scan_id string, keep long, keep_stem string, resource_id long, stem string, similarity double, verified_on string, fingerprints_deleted long")
            self.scans.log_deletions(log.withColumn("deleted_at", F.current_timestamp()))
            for t in out["tracks"]:
                t["fingerprints_deleted"] = gone.get(t["resource_id"], 0)
        return out

    def stats(self) -> DataFrame:
        return statistics(self.catalog.metadata())

    def metadata(self, ids: list[int]) -> DataFrame:
        rows = self.catalog.metadata().where(F.col("resource_id").isin(ids))
        return rows.select("resource_id", metadata_text(F.col("resource_id"), F.col("path"), F.col("duration"), F.col("num_fingerprints")).alias("line"))

    def resolve(self, paths: list[str]) -> DataFrame:
        """The ids that resources of these paths have."""
        df = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return df.select("path", resource_id(F.col("path")).alias("resource_id"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns its lines, which are printed too."""
    parser = argparse.ArgumentParser(prog="peakfold")
    parser.add_argument("--base", required=True)
    parser.add_argument("--strategy", default="exact")
    parser.add_argument("command", choices=["store", "load", "query", "monitor", "scan", "duplicates", "delete", "stats", "metadata", "resolve", "print", "compact", "clear", "store-sound", "query-sound", "deduplication", "same", "scan-new", "progress"])
    parser.add_argument("arguments", nargs="*")
    args = parser.parse_args(argv)
    spark = spark or session("peakfold")
    engine, rest = Engine(spark, args.base, args.strategy), args.arguments
    read = spark.read.parquet
    frame, said = None, "ok"
    if args.command == "store":
        engine.store(read(rest[0]), read(rest[1]))
    elif args.command == "load":
        load_files(engine.catalog, rest[0])
    elif args.command == "query":
        frame = engine.query(read(rest[0])).orderBy("query_id", "place")
    elif args.command == "monitor":
        frame = engine.monitor(read(rest[0])).orderBy("recording").select("json")
    elif args.command == "scan":
        said = f"{engine.scan(rest[0])} pairs"
    elif args.command == "duplicates":
        frame = engine.duplicates(*map(int, rest)).select("json")
    elif args.command == "delete":
        frame = engine.catalog.delete(requested_ids(spark, list(map(int, rest))))
    elif args.command == "stats":
        frame = engine.stats()
    elif args.command == "metadata":
        frame = engine.metadata([int(i) for i in rest]).select("line")
    elif args.command == "resolve":
        frame = engine.resolve(rest)
    elif args.command == "print":
        ids = spark.createDataFrame([(int(i),) for i in rest], "resource_id long")
        frame = print_lines(engine.catalog.fingerprints().drop("f1").join(ids, "resource_id", "left_semi").orderBy("resource_id", "t1", "hash"))
    elif args.command in ("store-sound", "query-sound"):
        files = spark.read.format("binaryFile").load(rest).select("path", "content")
        frame = engine.store_sound(files).orderBy("path") if args.command == "store-sound" else engine.query_sound(files).orderBy("query_id", "place")
    elif args.command == "deduplication":
        frame = engine.deduplication(read(rest[0]), read(rest[1]) if len(rest) > 1 else None).orderBy("query_id", "place")
    elif args.command == "same":
        said = f"{engine.same(read(rest[0]), read(rest[1])):.4f}"
    elif args.command == "scan-new":
        said = f"{engine.scan_new(rest[0], spark.createDataFrame([(int(i),) for i in rest[1:]], 'resource_id long'))} pairs"
    elif args.command == "progress":
        said = json.dumps(engine.scan_progress(rest[0]))
    elif args.command == "compact":
        engine.catalog.compact(lists="lists" in rest)
    else:
        engine.catalog.clear()
    lines = [said] if frame is None else [r[0] if len(r) == 1 and isinstance(r[0], str) else json.dumps(r.asDict(), default=str) for r in frame.toLocalIterator()]
    for line in lines:
        print(line)
    return lines


if __name__ == "__main__":
    main()
