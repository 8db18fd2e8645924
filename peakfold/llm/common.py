"""What the operators of this subpackage share: reading, Arrow batches, memo tables, shipped files."""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfold.session import application_folder, own_folder, remove, ship_package

#: Rows of one Arrow batch: texts average a few kB, so a batch stays at some MB.
BATCH_ROWS = 1000
#: Bytes at which a batch ends before it has so many rows.
BATCH_BYTES = 32 << 20
#: Bytes of text that one step of an operator holds beside its results.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with batches of bounded size; Spark reads that bound from the session when the plan runs, so it stays set."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def shipped_file(spark: SparkSession, path: str, stem: str) -> Ship:
    """A file that the driver has, such as a tokenizer's, for the executors."""
    with open(path, "rb") as f:
        return Ship(spark, f.read(), stem)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Batches cut so that the texts of each have about limit bytes at most (one text may have more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def texts_of(batch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def out_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class Numbering(dict):
    """Numbers its keys in order of first use; ``new`` lists the keys not yet taken up."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs flat[starts[c] : starts[c] + lens[c]] of all codes c, end to end."""
    n = lens[codes]
    total = int(n.sum())
    if not total:
        return flat[:0]
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (np.cumsum(n) - n), n)]


class IdMemo:
    """Ids of text pieces, computed once per distinct piece; short pieces are kept for later calls.

    ``encode_many(pieces)`` returns a list of id sequences. A piece of more than LONGEST characters is
    dropped when its call ends, so a text without blanks leaves nothing behind; when the kept pieces and
    ids reach MOST_BYTES all are dropped and collected anew. Results don't depend on either.
    """

    LONGEST, MOST_BYTES, PER_PIECE = 64, 112 << 20, 200

    def __init__(self, encode_many):
        self.encode_many = encode_many
        self.reset()

    def reset(self) -> None:
        self.numbers = Numbering()
        self._flat, self._starts, self._lens = np.empty(1 << 12, np.uint32), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.pieces = self.used = self.bytes = 0

    @property
    def flat(self) -> np.ndarray:
        return self._flat[: self.used]

    @property
    def starts(self) -> np.ndarray:
        return self._starts[: self.pieces]

    @property
    def lens(self) -> np.ndarray:
        return self._lens[: self.pieces]

    def codes(self, pieces: list) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    @staticmethod
    def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
        """The array, or one at least twice as large with the used part copied: growth costs little a piece."""
        if used + more <= len(x):
            return x
        out = np.empty(max(used + more, 2 * len(x)), x.dtype)
        out[:used] = x[:used]
        return out

    def take_up(self) -> None:
        """Encodes the pieces numbered since the last call."""
        if not self.numbers.new:
            return
        ids = self.encode_many(self.numbers.new)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lens.sum())
        self._flat, self._starts, self._lens = self._room(self._flat, self.used, total), self._room(self._starts, self.pieces, len(ids)), self._room(self._lens, self.pieces, len(ids))
        self._flat[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self._starts[self.pieces : self.pieces + len(ids)] = self.used + np.cumsum(lens) - lens
        self._lens[self.pieces : self.pieces + len(ids)] = lens
        self.pieces += len(ids)
        self.used += total
        self.numbers.new = []

    def call(self, pieces_of_texts):
        """Per text the codes of its pieces; to be followed by end() once their ids are gathered."""
        if self.bytes > self.MOST_BYTES:
            self.reset()
        self.mark = (self.pieces, self.used)
        codes = [self.codes(p) for p in pieces_of_texts]
        self.fresh = list(self.numbers.new)
        self.take_up()
        return codes

    def end(self) -> None:
        """Keeps the call's new short pieces only."""
        pieces, used = self.mark
        size = lambda p: len(p) if isinstance(p, (str, bytes)) else len(p[0])
        short = [k for k, p in enumerate(self.fresh) if size(p) <= self.LONGEST]
        if len(short) < len(self.fresh):
            at, lens = self._starts[pieces : self.pieces].copy(), self._lens[pieces : self.pieces].copy()
            for p in self.fresh:
                del self.numbers[p]
            for k in short:
                self.numbers[self.fresh[k]] = len(self.numbers)
            lens, flat = lens[short], gather(self._flat, at, lens, np.array(short, np.int64))
            self.pieces, self.used = pieces + len(short), used + len(flat)
            self._flat = np.concatenate([self._flat[:used], flat])
            self._starts[pieces : self.pieces], self._lens[pieces : self.pieces] = used + np.cumsum(lens) - lens, lens
            self.fresh = [self.fresh[k] for k in short]
        self.bytes += self.PER_PIECE * len(self.fresh) + 4 * (self.used - used)
        self.fresh = []

    def ids(self, pieces_of_texts: list[list]) -> list[np.ndarray]:
        codes = self.call(pieces_of_texts)
        out = [gather(self.flat, self.starts, self.lens, c) for c in codes]
        self.end()
        return out


class Ship:
    """A bounded file of the driver that every executor gets once; ``path()`` names it on an executor."""

    def __init__(self, spark: SparkSession, payload: bytes, stem: str):
        self.name = f"{stem}-{hashlib.sha256(payload).hexdigest()[:16]}.bin"
        path = os.path.join(own_folder(), self.name)
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(payload)
        os.replace(f"{path}.{os.getpid()}", path)
        spark.sparkContext.addFile(path)

    def path(self) -> str:
        return SparkFiles.get(self.name)


def checkpoint_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder that the cluster names, or of the warehouse where none is named."""
    return application_folder(spark)


#: The tables that scratch() will remove, innermost last.
_scratch: list[list[str]] = []


def written(df: DataFrame, stem: str, keep: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and outlives executors.

    Within scratch() the table goes when that ends, unless it is to be kept, as the result reads it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes at its end the tables that were written within it and aren't kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with a mark added while a column of the frame has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_held_out(col: str, modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus)) == remainder


def ordered(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds place, from 0, along the order, and under each name of sums the sum of its column over the rows before.

    Rows are dealt by ranges of the order; only each range's totals meet in one task, one row a range.
    """
    spark = df.sparkSession
    low = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    kept = written(low.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", 33)), "ordered")
    totals = kept.groupBy("_p").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    ranges = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_p", F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_n0"), *(F.coalesce(F.sum(f"_t_{k}").over(ranges), F.lit(0)).alias(f"_t_{k}") for k in sums))
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    out = kept.join(earlier, "_p")
    more = {k: F.col(f"_t_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}
    return out.withColumns({"place": F.col("_n0") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))} | more).select(*df.columns, "place", *sums)
