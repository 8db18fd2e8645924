"""The index as posting lists: a row a hash, with the resources that have it and their times.

Two tables, bucketed so that a lookup shuffles its query alone. Lists are bucketed by (hash, part): a hash
with many entries has several numbered parts, and a resource's entries are all in one of them. The
dictionary is bucketed by hash and says for each how many entries it has, how many one resource has at
most, and in how many parts they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold.operators.lookup import wanted
from peakfold.session import DENSE, written

#: Entries that a part of a list has at most, or nearly so; rows that a bucket is to have; most buckets.
LIST, BUCKET_ROWS, MOST_BUCKETS = 1024, 5_000_000, 50_000
#: Hashes with several parts up to which their table is broadcast while the lists are made.
MOST_BROADCAST, SALTS = 200_000, 16
PAIR = ["query_id", "resource_id"]
#: Hits, known from the dictionary before any is made, up to which a search makes them all at once.
FEW_HITS = 20_000_000
#: Hits that a task is to have where those of a pair have to stand together.
TASK_HITS = 1_000_000


def part_of(resource_id: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(resource_id), F.col(parts)).cast("int")


class Postings:
    """Posting lists as two tables of the session's catalog; reads and joins are by DataFrames of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def lists(self) -> DataFrame:
        """hash, part, entries (resource_id, at: t1 and f1 if there is one)."""
        return self.spark.read.table(f"{self.name}_lists").select("hash", "part", "entries")

    def dictionary(self) -> DataFrame:
        """hash, n, most, parts."""
        return self.spark.read.table(f"{self.name}_dictionary")

    @property
    def pitched(self) -> bool:
        return "f1" in self.lists().schema["entries"].dataType.elementType["at"].dataType.elementType.fieldNames()

    @classmethod
    def build(cls, index: DataFrame, path: str, name: str | None = None, longest: int = LIST, buckets: int | None = None) -> Postings:
        """index: hash, resource_id, t1, maybe f1, maybe n, how many rows the hash has; path: a folder that all machines
        share. Without n too long lists are found by an aggregate; their table goes to the others by broadcast while it is
        small, by a salted join else."""
        spark, name = index.sparkSession, name or f"postings_{uuid.uuid4().hex}"
        at = F.struct("t1", *(["f1"] if "f1" in index.columns else []))
        parts = F.ceil(F.col("n") * 2 / longest).cast("int")
        if "n" in index.columns:
            rows = index.withColumn("parts", F.when(F.col("n") > longest, parts)).drop("n")
        else:
            counts = index.groupBy("hash").agg(F.count("*").alias("n"))
            hot = written(counts.where(F.col("n") > longest).select("hash", parts.alias("parts")), "hot")
            if hot.count() <= MOST_BROADCAST:
                rows = index.join(F.broadcast(hot), "hash", "left")
            else:
                salted = hot.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
                rows = index.withColumn("salt", F.pmod(F.xxhash64("resource_id"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"], "left").drop("salt")
        if buckets is None:
            total = index.count()
            buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS)))
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part_of("resource_id", "parts")).repartition(buckets, "hash", "part")
        each = rows.groupBy("hash", "part", "resource_id").agg(F.sort_array(F.collect_list(at)).alias("at"), F.first("parts").alias("parts"))
        lists = each.groupBy("hash", "part").agg(F.sort_array(F.collect_list(F.struct("resource_id", "at"))).alias("entries"), F.sum(F.size("at")).alias("n"), F.max(F.size("at")).cast("long").alias("most"), F.first("parts").alias("parts"))
        cls._save(lists, f"{name}_lists", f"{path}/lists", buckets, "hash", "part")
        out = cls(spark, name)
        words = spark.read.table(f"{name}_lists").groupBy("hash").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("parts").alias("parts"))
        cls._save(words.repartition(buckets, "hash"), f"{name}_dictionary", f"{path}/dictionary", buckets, "hash")
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/form")  # last, so it is a mark
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str) -> Postings:
        """Lists that build() made at the path, in whatever session: their tables are declared where the catalog hasn't them."""
        for table, by in (("lists", "hash, part"), ("dictionary", "hash")):
            if not spark.catalog.tableExists(f"{name}_{table}"):
                buckets = spark.read.parquet(f"{path}/form").first()["buckets"]
                ddl = spark.read.parquet(f"{path}/{table}")._jdf.schema().toDDL()
                spark.sql(f"CREATE TABLE {name}_{table} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'")
        return cls(spark, name)

    @staticmethod
    def _save(df: DataFrame, name: str, path: str, buckets: int, *by: str) -> None:
        df.write.format("parquet").mode("overwrite").options(**DENSE).option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)

    def _found(self, asked: DataFrame) -> DataFrame:
        """asked: near_hash, parts and others. A row for each resource of their lists: the others, resource_id, at."""
        parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = self.lists().withColumnRenamed("hash", "near_hash").join(parts, ["near_hash", "part"])
        return met.select(*(c for c in parts.columns if c != "part"), F.explode("entries").alias("e")).select("*", "e.*").drop("e")

    def _of_resource(self, asked: DataFrame) -> DataFrame:
        """asked: near_hash, parts, resource_id and others. Their entries, from the one part that can have them.
        A merge join holds the rows of one key of its right side; that is the lists, of which a key has one row."""
        one = asked.withColumn("part", part_of("resource_id", "parts")).drop("parts")
        met = one.join(self.lists().withColumnRenamed("hash", "near_hash"), ["near_hash", "part"])
        return met.select(*(c for c in one.columns if c != "part"), F.explode(F.expr("filter(entries, e -> e.resource_id = resource_id)")).alias("e")).select("*", "e.at").drop("e")

    def _of_pairs(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """asked: query_id, near_hash, parts and others. Their entries of the query's pairs, as _found() gives them: each
        list is read once, however many queries ask for it, and meets the pairs by hash and resource."""
        rows = self._found(asked.select("near_hash", "parts").distinct())
        wanted_of = pairs.join(asked.drop("parts"), "query_id")  # a merge join holds the right side's rows of a key: fewer than ``least`` here
        return wanted_of.join(rows, ["near_hash", "resource_id"])

    def _hits(self, found: DataFrame, pitched: bool) -> DataFrame:
        rows = found.withColumn("x", F.explode("at"))
        more = [F.col("x.f1").alias("match_f1"), "query_f1"] if pitched else []
        return rows.select("query_id", "original_hash", "near_hash", "resource_id", F.col("x.t1").alias("match_time"), "query_time", *more)

    def _placed(self, prints: DataFrame, reach: int, attribution: str) -> DataFrame:
        words = self.dictionary().withColumnRenamed("hash", "near_hash")
        return words.join(wanted(prints, reach, attribution, self.pitched), "near_hash")

    def near_hits(self, prints: DataFrame, reach: int = 2, attribution: str = "last", avoid: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """All hits, as lookup.near_hits() gives them; only the query's rows are shuffled on the way to the lists."""
        pitched = self.pitched and "f1" in prints.columns
        asked = self._placed(prints, reach, attribution).drop("n", "most")
        if targets is None:
            found = self._found(asked)
        else:
            found = self._of_resource(asked.join(targets.select(*PAIR), "query_id"))
        if avoid is not None:
            found = found.join(avoid, [c for c in PAIR if c in avoid.columns], "left_anti")
        return self._hits(found, pitched)

    def candidates(self, prints: DataFrame, least: int, reach: int = 2, attribution: str = "last", avoid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(asked, pairs): see marked(), and the pairs that may have ``least`` hits, counted without making any.

        A pair with enough hits has some of the hashes that aren't put off, and at least as many there as the others
        can't give. So a hash that most resources have is read for few pairs.
        """
        asked = self.marked(prints, least, reach, attribution)
        return asked, self._counted(asked, least, avoid).select(*PAIR)

    def marked(self, prints: DataFrame, least: int, reach: int = 2, attribution: str = "last") -> DataFrame:
        """The query's hashes, with how many entries they have, marked whether they are put off (later).

        Of each query the hashes with the longest lists are put off, as long as all of them together give a
        resource fewer than ``least`` hits (slack).
        """
        line = Window.partitionBy("query_id").orderBy(F.desc("n"), "near_hash")
        given = F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, 0))
        marked = self._placed(prints, reach, attribution).withColumn("given", given).withColumn("later", F.col("given") < least)
        slack = F.coalesce(F.max(F.when(F.col("later"), F.col("given"))).over(Window.partitionBy("query_id")), F.lit(0))
        return written(marked.withColumn("slack", slack).drop("given", "most"), "asked")

    def _counted(self, asked: DataFrame, least: int, avoid: DataFrame | None) -> DataFrame:
        """The pairs that may have ``least`` hits, and how many they have at most."""
        met = self._found(asked.where("not later").select("query_id", "near_hash", "parts", "slack"))
        pairs = met.groupBy(*PAIR).agg(F.sum(F.size("at")).alias("seen"), F.first("slack").alias("slack")).where(F.col("seen") + F.col("slack") >= least)
        if avoid is not None:
            pairs = pairs.join(avoid, [c for c in PAIR if c in avoid.columns], "left_anti")
        return written(pairs.select(*PAIR, (F.col("seen") + F.col("slack")).alias("most")), "candidates")

    def search(self, prints: DataFrame, least: int, reach: int = 2, attribution: str = "last", avoid: DataFrame | None = None, few: int | None = None, together: bool = False) -> DataFrame:
        """The hits of all pairs that have ``least`` hits or more, and maybe of some that have fewer. Where there are
        more than ``few`` hits in all, they are counted first and made for the candidates alone. together: a pair's hits
        are in one task, for what sorts or joins them, and there are as many tasks as the known number of hits asks for."""
        pitched = self.pitched and "f1" in prints.columns
        asked = self.marked(prints, least, reach, attribution)
        total = asked.agg(F.sum("n")).first()[0] or 0
        if total <= (FEW_HITS if few is None else few):
            found = self._found(asked.drop("later", "slack", "n"))
            if avoid is not None:
                found = found.join(avoid, [c for c in PAIR if c in avoid.columns], "left_anti")
            hits = self._hits(found, pitched)
        else:
            counted, asked = self._counted(asked, least, avoid), asked.drop("n")
            total, pairs = (counted.agg(F.sum("most")).first()[0] or 0) if together else 0, counted.select(*PAIR)
            now = self._found(asked.where("not later").drop("later", "slack")).join(pairs, PAIR, "left_semi")
            put_off = self._of_pairs(asked.where("later").drop("later", "slack"), pairs)
            hits = self._hits(now, pitched).unionByName(self._hits(put_off, pitched))
        if not together:
            return hits
        return hits.repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_HITS)), *PAIR)
