"""The tables of the library's queries, taken from the star schema's tables; the only place that knows these."""

from __future__ import annotations

import re
import uuid
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold import session
from peakfold.config import Extraction
from peakfold.operators import ordering
from peakfold.session import application_folder
from peakfold.sources.postings import Postings

#: A "second" is ten words.
FRAMES = 10
#: Triples that are given on at a time; parts of the index for each piece of the documents that a task reads.
BATCH, PARTS = 100_000, 8
#: Frames of the vectors that stand for spectra: 64 bins, with the settings' rates.
SMALL = Extraction(size=128)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What stored() made, by application, folder and name; clean() empties it.
_stored = session.made


def stored(spark: SparkSession, sf_dir: str, name: str, build, **options: str) -> DataFrame:
    """A table that is made once for an application and a folder of tables, as a catalog keeps its index and
    the result of its last scan; read from the shared folder from then on. options: of the writer."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.options(**options).parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def shingles(spark, sf_dir, by_document: bool = False, where: str = "true") -> DataFrame:
    """hash, resource_id, t1: word triples of documents, cut and hashed a batch of texts at a time; by_document: see document_prints();
    where: the documents."""

    def run(batches):
        for batch in batches:
            keys, sizes, digests = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = text.split(b" ")
                if len(w) >= 3:
                    digests += [md5(b" ".join(g)).digest() for g in zip(w, w[1:], w[2:])]
                    keys.append(key)
                    sizes.append(len(w) - 2)
                if len(digests) >= BATCH:
                    yield triples(keys, sizes, digests)
                    keys, sizes, digests = [], [], []
            if digests:
                yield triples(keys, sizes, digests)

    def triples(keys, sizes, digests) -> pa.RecordBatch:
        n = np.array(sizes)
        hashes = np.frombuffer(b"".join(digests), ">u4")[::4].astype(np.int64)
        t1 = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
        if by_document:
            prints = pa.StructArray.from_arrays([pa.array(hashes), pa.array(t1.astype(np.int32))], names=["hash", "t1"])
            ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, prints)], names=["resource_id", "prints"])
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(np.array(keys, np.int64), n)), pa.array(t1.astype(np.int32))], names=["hash", "resource_id", "t1"])

    texts = table(spark, sf_dir, "documents").where("text is not null").where(where).select("doc_id", F.lower("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "resource_id long, prints array<struct<hash:long,t1:int>>" if by_document else "hash long, resource_id long, t1 int")


def document_prints(spark, sf_dir) -> DataFrame:
    """resource_id, prints (hash, t1): a row for each document that has triples, the same as shingles() has as rows."""
    return shingles(spark, sf_dir, by_document=True)


def whole_prints(spark, sf_dir) -> DataFrame:
    """The same with one row for each resource_id: documents that share an id are put together; those without one match nothing."""
    rows = document_prints(spark, sf_dir).where("resource_id is not null")
    ids = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.col("doc_id").alias("resource_id")).count().where("count > 1").select("resource_id")
    if ids.isEmpty():
        return rows
    several = rows.join(ids, "resource_id", "left_semi").groupBy("resource_id").agg(F.flatten(F.collect_list("prints")).alias("prints"))
    return rows.join(ids, "resource_id", "left_anti").unionByName(several)


def query_prints(spark, sf_dir) -> DataFrame:
    """As prints(), from the queries' texts, without an index."""
    return shingles(spark, sf_dir, where=f"doc_id % {EVERY} = 0").select(F.col("resource_id").alias("query_id"), F.col("t1").alias("pos"), "hash", "t1")


def counted_index(spark, sf_dir) -> DataFrame:
    """The stored index, in order of hash, so that a lookup's hashes can pass over most row groups. Each row also tells how
    many rows its hash has (n), the least resource of these (lo) and whether there are two (spread). Hashes are spread evenly over 32 bits, so they
    are dealt out by ranges of equal width; no pass over the texts looks for bounds."""

    def build():
        rows = shingles(spark, sf_dir)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * rows.rdd.getNumPartitions())
        placed = rows.withColumn("part", F.expr(f"cast(hash * {parts} div 4294967296 as int)")).repartitionById(parts, "part")
        w = Window.partitionBy("part", "hash")
        seen = placed.withColumns({"n": F.count("*").over(w), "lo": F.min("resource_id").over(w), "hi": F.max("resource_id").over(w)})
        return seen.withColumn("spread", F.col("lo") < F.col("hi")).drop("hi").sortWithinPartitions("part", "hash").drop("part")

    return stored(spark, sf_dir, "index", build, **session.DENSE)


def index(spark, sf_dir) -> DataFrame:
    return counted_index(spark, sf_dir).select("hash", "resource_id", "t1")


def postings(spark, sf_dir) -> Postings:
    """The index as posting lists with frequencies, made once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "postings")
    if key not in _stored:
        f1 = (F.expr("hash div 16") % 200 + 20).cast("int")
        _stored[key] = Postings.build(counted_index(spark, sf_dir).select("hash", "resource_id", "t1", "n").withColumn("f1", f1), f"{application_folder(spark)}/postings-{uuid.uuid4().hex}").name
    return Postings(spark, _stored[key])


def catalog(spark, sf_dir) -> DataFrame:
    n = F.size(F.split(F.lower("text"), " "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (n / 10.0).alias("duration"), F.greatest(n - 2, F.lit(0)).cast("long").alias("num_fingerprints"), F.col("lang").alias("title"))


#: Queries are the documents whose id this divides, against all.
EVERY = 20


def prints(spark, sf_dir) -> DataFrame:
    """Query prints: those of the documents whose id EVERY divides, the stated query set."""
    return index(spark, sf_dir).where(F.col("resource_id") % EVERY == 0).select(F.col("resource_id").alias("query_id"), F.col("t1").alias("pos"), "hash", "t1")


def vectors(spark, sf_dir) -> DataFrame:
    """resource_id, t, v: each label's vectors in order of their ids; a label of any size is spread over ranges of these."""

    def build():
        e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("resource_id"), "vec_id", F.col("embedding").alias("v"))
        return ordering.placed_within(e, "resource_id", "vec_id").select("resource_id", F.col("place").cast("int").alias("t"), "v")

    return stored(spark, sf_dir, "vectors", build)


def frames(spark, sf_dir) -> DataFrame:
    """resource_id, t, m: spectra as arrays."""
    return vectors(spark, sf_dir).select("resource_id", "t", F.transform("v", lambda x: x.cast("double") * x.cast("double")).alias("m"))


def spectrum(spark, sf_dir) -> DataFrame:
    """The same with a row a bin."""
    return frames(spark, sf_dir).select("resource_id", "t", F.posexplode("m").alias("f", "m"))


#: Signals that stand for sound: a label's vectors end to end, 64 samples each; frames of two vectors that share one.
SIGNAL = Extraction(size=128, step=64)


def signals(spark, sf_dir) -> DataFrame:
    """resource_id, at, samples: pieces of each label's signal."""
    return vectors(spark, sf_dir).select("resource_id", (F.col("t").cast("long") * 64).alias("at"), F.col("v").cast("array<float>").alias("samples"))


def detections(spark, sf_dir) -> DataFrame:
    start = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), start.alias("start"), (start + 28800).alias("stop"), F.col("value").alias("score"), (F.col("value") / 100).alias("pct"), "event_id", "event_type")


def pitches(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("resource_id"), (F.col("value") + 55).alias("hz"))


SQL = {
    "fp": "fp AS (SELECT CAST('0x' || substr(md5(w[i] || ' ' || w[i+1] || ' ' || w[i+2]), 1, 8) AS BIGINT) AS hash, resource_id, CAST(i - 1 AS INTEGER) AS t1 FROM (SELECT doc_id AS resource_id, string_split(lower(text), ' ') AS w FROM documents) d, unnest(range(1, len(w) - 1)) AS g(i))",
    "cat": "cat AS (SELECT doc_id AS resource_id, source || '/' || doc_id || '.txt' AS path, len(string_split(lower(text), ' ')) / 10.0::DOUBLE AS duration, CAST(greatest(len(string_split(lower(text), ' ')) - 2, 0) AS BIGINT) AS num_fingerprints, lang AS title FROM documents)",
    "qp": "qp AS (SELECT resource_id AS query_id, t1 AS pos, hash, t1 FROM fp WHERE resource_id % 20 = 0)",
    "spec": "spec AS (SELECT CAST(label AS BIGINT) AS resource_id, CAST(t AS INTEGER) AS t, CAST(i - 1 AS INTEGER) AS f, CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS m FROM (SELECT label, embedding, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings) e, unnest(range(1, len(embedding) + 1)) AS g(i))",
    "det": "det AS (SELECT user_id AS id, floor(epoch(ts)) AS start, floor(epoch(ts)) + 28800 AS stop, value AS score, value / 100 AS pct, event_id, event_type FROM events)",
    "pit": "pit AS (SELECT user_id AS resource_id, value + 55 AS hz FROM events)",
}
_PTS = """vm AS (SELECT *, max(m) OVER (PARTITION BY resource_id, t ORDER BY f ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS vmax FROM spec),
hm AS (SELECT *, max(vmax) OVER w AS hmax, count(*) OVER w AS frames FROM vm WINDOW w AS (PARTITION BY resource_id, f ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
pts AS (SELECT resource_id, t, f, m FROM hm WHERE frames = 24 AND m = vmax AND m = hmax AND m <> 0)"""
SQL["pts"] = SQL["spec"] + ",\n" + _PTS
_STEP = "{a}.resource_id = {b}.resource_id AND {b}.t - {a}.t BETWEEN 2 AND 33 AND abs({b}.f - {a}.f) BETWEEN 1 AND 128"
SQL["tri"] = SQL["pts"] + ",\ntri AS (SELECT p.resource_id, p.t AS t1, p.f AS f1, p.m AS m1, q.t AS t2, q.f AS f2, q.m AS m2, r.t AS t3, r.f AS f3, r.m AS m3 FROM pts p JOIN pts q ON " + _STEP.format(a="p", b="q") + " JOIN pts r ON " + _STEP.format(a="q", b="r") + ")"
SQL["hits"] = (
    SQL["fp"] + ",\n" + SQL["qp"] + """,
near AS (SELECT query_id, hash + d AS near_hash, arg_max(hash, pos) AS original_hash FROM qp, unnest(range(-2, 3)) AS g(d) GROUP BY 1, 2),
qt AS (SELECT query_id, hash AS original_hash, arg_max(t1, pos) AS query_time FROM qp GROUP BY 1, 2),
hits AS (SELECT n.query_id, n.original_hash, n.near_hash, f.resource_id, f.t1 AS match_time, q.query_time FROM near n JOIN fp f ON f.hash = n.near_hash JOIN qt q ON q.query_id = n.query_id AND q.original_hash = n.original_hash)"""
)
SQL["marked"] = SQL["hits"] + """,
hn AS (SELECT *, match_time - query_time AS dt, count(*) OVER (PARTITION BY query_id, resource_id) AS n, row_number() OVER (PARTITION BY query_id, resource_id ORDER BY query_time, match_time, near_hash) AS rnk FROM hits),
marked AS (SELECT *, rnk <= least(250, greatest(10, n // 5)) AS is_first, rnk > n - least(250, greatest(10, n // 5)) AS is_last FROM hn WHERE n >= 10)"""
SQL["lines"] = SQL["marked"] + """,
bydt AS (SELECT query_id, resource_id, dt, count(*) FILTER (is_first) AS k1, count(*) FILTER (is_last) AS k2, min(query_time) FILTER (is_first) AS x1, max(query_time) FILTER (is_last) AS x2 FROM marked GROUP BY 1, 2, 3),
m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, resource_id ORDER BY k1 DESC, abs(dt), dt) AS o FROM bydt) WHERE o = 1),
m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, resource_id ORDER BY k2 DESC, abs(dt), dt) AS o FROM bydt) WHERE o = 1),
ends AS (SELECT m1.query_id, m1.resource_id, m1.dt AS y1, m1.x1, m2.dt AS y2, m2.x2 FROM m1 JOIN m2 ON m1.query_id = m2.query_id AND m1.resource_id = m2.resource_id),
lines AS (SELECT *, -x1 * slope + y1 AS "offset", 1 - slope AS time_factor FROM (SELECT *, CASE WHEN x2 <> x1 THEN (y2 - y1) / (x2 - x1)::DOUBLE END AS slope FROM ends))"""
SQL["aligned"] = SQL["lines"] + """,
kept AS (SELECT m.*, l.time_factor FROM marked m JOIN lines l ON m.query_id = l.query_id AND m.resource_id = l.resource_id WHERE l.time_factor > 0.9 AND l.time_factor < 1.1 AND abs(m.dt - (l.slope * m.query_time + l."offset")) <= 2),
agg AS (SELECT query_id, resource_id, count(*) AS score, min(query_time) AS q0, max(query_time) AS q1, arg_min(match_time, rnk) AS r0, arg_max(match_time, rnk) AS r1, any_value(time_factor) AS time_factor FROM kept GROUP BY 1, 2 HAVING count(*) > 5 AND (max(query_time) - min(query_time)) * 0.1::DOUBLE >= 5),
cov AS (SELECT k.query_id, k.resource_id, count(DISTINCT CAST(trunc(k.match_time * 0.1::DOUBLE - a.r0 * 0.1::DOUBLE) AS INTEGER)) AS covered FROM kept k JOIN agg a ON k.query_id = a.query_id AND k.resource_id = a.resource_id GROUP BY 1, 2),
aligned AS (SELECT * FROM (SELECT a.query_id, a.resource_id, q0 * 0.1::DOUBLE AS query_start, q1 * 0.1::DOUBLE AS query_stop, r0 * 0.1::DOUBLE AS ref_start, r1 * 0.1::DOUBLE AS ref_stop, score, time_factor, CASE WHEN ceil((r1 - r0) * 0.1::DOUBLE) > 0 THEN 1 - (ceil((r1 - r0) * 0.1::DOUBLE) - covered) / ceil((r1 - r0) * 0.1::DOUBLE) END AS share FROM agg a JOIN cov c ON a.query_id = c.query_id AND a.resource_id = c.resource_id) WHERE share >= 0.2)"""
SQL["buckets"] = SQL["fp"] + ",\n" + SQL["cat"] + """,
ok AS (SELECT hash FROM fp GROUP BY 1 HAVING count(*) <= 256),
rows2 AS (SELECT f.*, c.duration FROM fp f JOIN cat c ON f.resource_id = c.resource_id WHERE c.duration > 0 AND f.hash IN (SELECT hash FROM ok) AND f.hash IN (SELECT hash FROM fp GROUP BY 1 HAVING min(resource_id) < max(resource_id))),
buckets AS (SELECT x.resource_id AS a, y.resource_id AS b, CAST((y.t1 - x.t1 + 104) // 4 AS BIGINT) AS bucket, count(*) AS hits, list(DISTINCT x.t1 // 10) AS sa, list(DISTINCT y.t1 // 10) AS sb FROM rows2 x JOIN rows2 y ON x.hash = y.hash WHERE x.resource_id < y.resource_id AND abs(y.t1 - x.t1) <= 100 AND abs(y.duration - x.duration) <= 15 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
tracks AS (SELECT f.resource_id, count(*) AS fingerprints, count(DISTINCT CASE WHEN o.hash IS NOT NULL THEN f.t1 // 10 END) AS eligible_seconds, list(DISTINCT CASE WHEN o.hash IS NOT NULL THEN f.t1 // 10 END) AS secs FROM fp f LEFT JOIN ok o ON f.hash = o.hash GROUP BY 1)"""
SQL["pairs"] = SQL["buckets"] + """,
peak AS (SELECT * FROM (SELECT a, b, bucket AS peak, row_number() OVER (PARTITION BY a, b ORDER BY hits DESC, bucket) AS o FROM buckets) WHERE o = 1),
sums AS (SELECT x.a, x.b, x.peak, sum(y.hits)::BIGINT AS aligned_hits, list_distinct(flatten(list(y.sa))) AS sa, list_distinct(flatten(list(y.sb))) AS sb FROM peak x JOIN buckets y ON x.a = y.a AND x.b = y.b AND abs(y.bucket - x.peak) <= 1 GROUP BY 1, 2, 3),
pairs AS (SELECT * FROM (SELECT s.a, s.b, (peak * 4 - 104 + 2) / 10.0::DOUBLE AS offset_seconds, aligned_hits, len(list_intersect(s.sa, ta.secs)) / ta.eligible_seconds::DOUBLE AS coverage_a, len(list_intersect(s.sb, tb.secs)) / tb.eligible_seconds::DOUBLE AS coverage_b FROM sums s JOIN tracks ta ON ta.resource_id = s.a JOIN tracks tb ON tb.resource_id = s.b WHERE ta.eligible_seconds > 0 AND tb.eligible_seconds > 0) WHERE least(coverage_a, coverage_b) >= 0.5)"""
SQL["groups"] = SQL["pairs"] + """,
adj AS (SELECT a AS id, b AS other, least(coverage_a, coverage_b) AS s FROM pairs UNION ALL SELECT b, a, least(coverage_a, coverage_b) FROM pairs),
reach AS (SELECT id, id AS r FROM adj UNION SELECT reach.id, adj.other FROM reach JOIN adj ON reach.r = adj.id),
groups AS (SELECT id, min(r) AS component FROM reach GROUP BY 1),
members AS (SELECT g.id, g.component, z.size, max(j.s) AS mx, min(j.s) AS mn, sum(j.s) / (z.size - 1) AS mean_s FROM groups g JOIN adj j ON j.id = g.id JOIN (SELECT component, count(*) AS size FROM groups GROUP BY 1) z ON z.component = g.component GROUP BY 1, 2, 3)"""


#: Names of the steps from hits to matches, so that several such chains can stand in one statement.
_STEPS = "near qt hits hn marked bydt m1 m2 ends lines kept agg cov aligned".split()
_HZ = "(8.17579892 * pow(2, (1200 * log2(110 / 8.17579892) + {} * 1200 / 85) / 1200))"


def chain(mark: str, fp: str = "fp", qp: str = "qp", target: str = "", tolerant: bool = False) -> str:
    """The steps from query prints (qp) over an index (fp) to aligned<mark>; target: a table of query_id and resource_id."""
    text = SQL["aligned"].split(SQL["qp"] + ",\n", 1)[1]
    text = re.sub(r"\b(" + "|".join(_STEPS) + r")\b", rf"\g<1>{mark}", text)
    text = re.sub(r"\bqp\b", qp, text)
    text = re.sub(r"\bJOIN fp f\b", f"JOIN {fp} f", text)
    if target:
        text = text.replace("AND q.original_hash = n.original_hash)", f"AND q.original_hash = n.original_hash JOIN {target} tg ON tg.query_id = n.query_id AND tg.resource_id = f.resource_id)", 1)
    if tolerant:
        text = text.replace("arg_max(t1, pos) AS query_time", "arg_max(t1, pos) AS query_time, arg_max(f1, pos) AS query_f1", 1)
        text = text.replace("q.query_time FROM", "q.query_time, f.f1 AS match_f1, q.query_f1 FROM", 1)
        text = text.replace("max(query_time) FILTER (is_last) AS x2", "max(query_time) FILTER (is_last) AS x2, arg_min({'a': match_f1, 'b': query_f1}, rnk) FILTER (is_first) AS f", 1)
        text = text.replace(f"m1{mark}.x1, m2{mark}.dt AS y2", f"m1{mark}.x1, m1{mark}.f, m2{mark}.dt AS y2", 1)
        text = text.replace("1 - slope AS time_factor", f"CASE WHEN slope <> 1 THEN 1 / (1 - slope) END AS time_factor, {_HZ.format('f.a')} / {_HZ.format('f.b')} AS frequency_factor", 1)
        text = text.replace("l.time_factor FROM", "l.time_factor, l.frequency_factor FROM", 1).replace("l.time_factor > 0.9 AND l.time_factor < 1.1", "l.time_factor > 0.8 AND l.time_factor < 1.2 AND l.frequency_factor > 0.8 AND l.frequency_factor < 1.2", 1)
        text = text.replace("any_value(time_factor) AS time_factor", "any_value(time_factor) AS time_factor, any_value(frequency_factor) AS frequency_factor", 1).replace("score, time_factor, CASE WHEN ceil", "score, time_factor, frequency_factor, CASE WHEN ceil", 1)
    return text


def sql(parts: str, select: str) -> str:
    """parts: names of common tables, comma-separated; recursive ones are allowed."""
    return "WITH RECURSIVE " + ",\n".join(SQL[p] for p in parts.split(",")) + "\n" + select
