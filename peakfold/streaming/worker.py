"""Requests from a stream: store, monitor and patch, with at-least-once delivery.

Each kind is a foreachBatch function. Work is done before its results are published, and a batch that runs
twice finds its work done, so a failure between the two repeats results but loses none. What is wrong with
a single request is a result of its own and doesn't stop the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold.config import Matching, Monitoring
from peakfold.functions.ident import json_long, json_text, segments
from peakfold.operators import monitor
from peakfold.session import written
from peakfold.sources.catalog import Catalog, complete, from_json
from peakfold.sources.results import monitor_json

MESSAGE = "key string, value string"
#: Kinds of workers, and the requests that each takes.
MODES = {"stage1": ("store", "monitor"), "refine": ("refine", "patch"), "both": ("store", "monitor", "refine", "patch")}
Publish = Callable[[DataFrame], None]


def classified(asked: DataFrame, known: DataFrame, prints: DataFrame, copies: DataFrame) -> DataFrame:
    """Adds status to store requests (resource_id): error without an id, already_exists where the catalog has
    it (known), skipped_empty without prints (num_fingerprints), already_indexed_match with its original where
    the catalog has the same content (copies: resource_id, original), repeated where an earlier request of the
    batch has the id (first false), else ok."""
    rows = asked.join(known.select("resource_id", F.lit(True).alias("_known")), "resource_id", "left").join(prints.select("resource_id", "num_fingerprints"), "resource_id", "left").join(copies.select("resource_id", "original"), "resource_id", "left")
    first = F.col("first") if "first" in asked.columns else F.lit(True)
    status = F.when(F.col("resource_id").isNull(), "error").when(F.col("_known"), "already_exists").when(F.coalesce("num_fingerprints", F.lit(0)) <= 0, "skipped_empty").when(F.col("original").isNotNull(), "already_indexed_match").when(~first, "repeated").otherwise("ok")
    return rows.withColumn("status", status).withColumn("original", F.when(F.col("status") == "already_indexed_match", F.col("original"))).drop("_known")


def content_copies(prints: DataFrame, catalog_prints, meta: DataFrame, match: Matching) -> DataFrame:
    """(resource_id, original): requests whose whole content another resource of the catalog has; of several the one with the best score, then the smaller id."""
    frames = 1 / match.seconds_per_frame
    totals = meta.select(F.col("resource_id").alias("recording"), F.floor(F.col("duration") * frames).cast("long").alias("total"))
    found = monitor.whole_copies(prints.withColumnRenamed("resource_id", "recording"), totals, catalog_prints, match, avoid=totals.select("recording", F.col("recording").alias("resource_id")))
    return found.groupBy("recording").agg(F.min(F.struct(-F.col("score"), "resource_id")).alias("b")).select(F.col("recording").alias("resource_id"), F.col("b.resource_id").alias("original"))


def store_batch(catalog: Catalog, publish: Publish, match: Matching = Matching()) -> Callable[[DataFrame, int], None]:
    """Store requests: they are judged, those that are ok are stored, then all results go out with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        has_f1 = F.col("f1")
        prints = written(from_json(batch).where("identifier is not null").withColumnRenamed("identifier", "resource_id").groupBy("resource_id", "hash", "t1").agg(F.min(has_f1).alias("f1"), F.max("filename").alias("filename"), F.max("duration").alias("duration"), F.max("title").alias("title"), F.max("audio_url").alias("audio_url")), "request")
        meta = prints.groupBy("resource_id").agg(F.max("filename").alias("path"), F.max("duration").alias("duration"), F.count("*").alias("num_fingerprints"), F.max("title").alias("title"), F.max("audio_url").alias("audio_url"))
        known = catalog.metadata().where(complete())
        live = catalog.fingerprints().join(known.select("resource_id"), "resource_id", "left_semi")
        fresh = meta.join(known.select("resource_id"), "resource_id", "left_anti")
        copies = content_copies(prints.select("resource_id", "hash", "t1"), live.select("hash", "resource_id", "t1"), fresh, match)
        asked = batch.select("key", F.get_json_object("value", "$.identifier").try_cast("long").alias("resource_id"))
        asked = asked.withColumn("first", F.row_number().over(Window.partitionBy("resource_id").orderBy("key")) == 1)
        results = written(classified(asked, known, meta, copies).select("key", "resource_id", "status", "original", F.lit(number).alias("batch")), "results")
        ok = results.where("status = 'ok'").select("resource_id")
        catalog.restore_incomplete(prints.select("hash", "resource_id", "t1", "f1").join(ok, "resource_id", "left_semi"), meta.join(ok, "resource_id", "left_semi"))
        publish(results)

    return run


def monitor_batch(catalog: Catalog, publish: Publish, match: Matching = Matching(), m: Monitoring = Monitoring()) -> Callable[[DataFrame, int], None]:
    """Monitor requests, whole recordings or segments of them, as JSON results. A request's prints come with it.

    A window that fails fails its batch, which runs again as a whole: no request gets a part of its results.
    """

    def run(batch: DataFrame, number: int) -> None:
        fps = 1 / match.seconds_per_frame
        prints = from_json(batch).where("identifier is not null").select(F.col("identifier").alias("recording"), "hash", "t1")
        parts = batch.select(F.get_json_object("value", "$.identifier").try_cast("long").alias("recording"), segments(F.col("value")).alias("s"))
        whole = parts.where("s is null").select("recording")
        some = parts.where("s is not null").select("recording", F.explode("s").alias("s"))
        inside = prints.join(some, "recording").where((F.col("t1") >= F.col("s.start_seconds") * fps) & (F.col("t1") < F.col("s.end_seconds") * fps)).select("recording", "hash", "t1").distinct()
        taken = written(prints.join(whole, "recording", "left_semi").unionByName(inside), "request")
        known = catalog.metadata().where(complete())
        live = catalog.fingerprints().join(known.select("resource_id"), "resource_id", "left_semi").select("hash", "resource_id", "t1")
        recordings = taken.groupBy("recording").agg((F.max("t1") + 1).cast("long").alias("total"))
        rows = monitor.monitor(taken, recordings, live, known.select("resource_id", (F.col("duration") * fps).alias("duration")), match, m)
        listed = monitor_json(monitor.tracks_of(rows, m, match.seconds_per_frame), known)
        asked = batch.select("key", F.get_json_object("value", "$.identifier").try_cast("long").alias("recording"))
        none = F.lit('{"status":"ok","unique_tracks_count":0,"matches":[]}')
        publish(written(asked.join(listed, "recording", "left").select("key", "recording", F.when(F.col("recording").isNull(), F.lit('{"status":"error"}')).otherwise(F.coalesce("json", none)).alias("json"), F.lit(number).alias("batch")), "results"))

    return run


def patch_batch(catalog: Catalog, publish: Publish | None = None) -> Callable[[DataFrame, int], None]:
    """Rename and delete requests in the order of their keys: of a resource the last rename before its first
    deletion counts, and what comes after the deletion finds nothing."""

    def run(batch: DataFrame, number: int) -> None:
        value = F.col("value")
        action = F.coalesce(json_text(value, "action"), F.lit("rename"))
        rows = batch.select("key", action.alias("action"), F.coalesce(json_long(value, "identifier"), json_long(value, "resource_id")).alias("resource_id"), F.coalesce(json_text(value, "new_path"), F.lit("")).alias("path"))
        gone = F.min(F.when(F.col("action") == "delete", F.col("key"))).over(Window.partitionBy("resource_id"))
        known = catalog.metadata().select("resource_id", F.lit(True).alias("known"))
        rows = rows.withColumn("gone", gone).join(known, "resource_id", "left")
        wrong = F.col("resource_id").isNull() | ~F.col("action").isin("rename", "delete") | ((F.col("action") == "rename") & (F.col("path") == ""))
        status = F.when(wrong, "error").when(F.col("known").isNull() | (F.col("key") > F.col("gone")), "not_found").otherwise("ok")
        results = written(rows.withColumn("status", status).withColumn("batch", F.lit(number)), "results")
        ok = results.where("status = 'ok'")
        catalog.rename_all(ok.where("action = 'rename'").groupBy("resource_id").agg(F.max_by("path", "key").alias("path")))
        ids = ok.where("action = 'delete'").select("resource_id").distinct()
        if not ids.isEmpty():
            catalog.delete(ids)
        if publish:
            publish(results.select("key", "resource_id", "action", "status", "batch"))

    return run


def start_workers(spark: SparkSession, mode: str, sources: dict[str, DataFrame], handlers: dict[str, Callable], checkpoints: str) -> list:
    """A streaming query for each kind of request that the mode takes, each with a checkpoint and a scheduler pool of its own.
    Requests that come with their time (ts) are taken once, however often and in whatever batch they come."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    out = []
    for kind in MODES[mode]:
        if kind in sources and kind in handlers:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", kind)
            rows = unique_entries(sources[kind], ["key", "value"]) if "ts" in sources[kind].columns else sources[kind]
            out.append(rows.writeStream.foreachBatch(handlers[kind]).option("checkpointLocation", f"{checkpoints}/{kind}").queryName(f"{kind}-worker").start())
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    return out


def kafka_source(spark: SparkSession, servers: str, topic: str, a_trigger: int = 1) -> DataFrame:
    """Messages of a topic, so many a batch; needs the Kafka package on the session."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", a_trigger).option("startingOffsets", "earliest").load()
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def kafka_sink(servers: str, topic: str) -> Publish:
    """Publishes results' keys and rows as JSON; needs the Kafka package on the session."""

    def publish(results: DataFrame) -> None:
        results.select("key", F.to_json(F.struct(*results.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return publish


def routed(first: Publish, second: Publish) -> Publish:
    """Publishes to the first place, or where that fails to the second; if both fail the batch does."""

    def publish(results: DataFrame) -> None:
        try:
            first(results)
        except Exception:
            second(results)

    return publish


def long_enough(windows: DataFrame, samples: str = "samples", rate: int = 16000) -> DataFrame:
    """Windows of one second of sound at least."""
    return windows.where(F.col(samples) >= rate)


def first_entries(entries: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Of entries that are equal in the columns, the one with the smallest id."""
    return entries.groupBy(*columns).agg(F.min(order).alias(order))


def unique_entries(stream: DataFrame, columns: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream's entries without those that are equal in the columns to one that came before, in whatever batch.

    What has come is keyed state in the checkpoint, so a restart knows it; it is kept until the watermark has
    passed an entry's time by ``late``, so the state's size follows the rate of entries and not their number.
    """
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(columns)


def hopping(events: DataFrame, late: str = "10 minutes", length: str = "30 minutes", hop: str = "20 minutes") -> DataFrame:
    """Counts and sums by event time in overlapping windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, hop).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
