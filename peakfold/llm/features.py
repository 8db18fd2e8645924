"""Hashed text features, bounded labelled samples, and sparse rows for the numpy models."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import IdMemo, bytes_of, free_name, map_arrow, out_batch, slices, texts_of, written

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def char_ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """A hashed index for each n-gram of code points; the text is taken whole, with a blank at each end."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in orders:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * _MIX[k]
            out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def counts(index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices in order and how often each occurs."""
    if len(index) * 8 < 1 << bits:
        return np.unique(index, return_counts=True)
    n = np.bincount(index, minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at]


class CharVector:
    """Character n-grams of a text as (indices, log counts)."""

    ones = False

    def __init__(self, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, lower: bool = False):
        self.orders, self.bits, self.lower, self.width = orders, bits, lower, 1 << bits

    def rows(self, batch) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t in texts_of(batch):
            at, n = counts(char_ngrams(t.lower() if self.lower else t, self.orders, self.bits), self.bits)
            out.append((at, np.log1p(n).astype(np.float32)))
        return out


class WordVector:
    """Distinct words of a text, their beginnings and inner n-grams, as (indices, ones)."""

    ones = True  # all values are 1
    EDGE = b".,!?;:\"'()[]{}#*$%&|<>-_"

    def __init__(self, bits: int = 18, starts: tuple[int, ...] = (4, 5, 6), inner: int = 0):
        self.bits, self.starts, self.inner, self.kept, self.width = bits, starts, inner, None, 1 << bits
        self._memo = None

    def only(self, at: np.ndarray) -> WordVector:
        """The same features, those among ``at`` alone, numbered by their place there."""
        out = WordVector(self.bits, self.starts, self.inner)
        out.kept, out.width = {int(x): k for k, x in enumerate(at)}, max(1, len(at))
        return out

    @property
    def memo(self) -> IdMemo:
        """Made where it is used, once per task."""
        if self._memo is None:
            self._memo = IdMemo(self._words)
        return self._memo

    def _words(self, words: list[bytes]) -> list[list[int]]:
        shift, out = 32 - self.bits, []
        for w in words:
            w = w.strip(self.EDGE).decode("utf-8", "replace").lower()
            if not w:
                out.append([])
                continue
            parts = [f"w {w}", *(f"{n} {w[:n]}" for n in self.starts if len(w) >= n)]
            if self.inner:
                parts += [f"i {w[k : k + self.inner]}" for k in range(1, len(w) - self.inner + 1)]
            at = [zlib.crc32(p.encode()) * 2654435761 % (1 << 32) >> shift for p in parts]
            out.append(at if self.kept is None else [self.kept[x] for x in at if x in self.kept])
        return out

    def rows(self, batch) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for ids in self.memo.ids([t.lower().split() for t in bytes_of(batch)]):
            at = np.unique(ids).astype(np.int64)
            out.append((at, np.ones(len(at), np.float32)))
        return out


class Rows:
    """Sparse rows end to end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width, self.size = width, len(rows)
        self.lens = np.array([len(r[0]) for r in rows], np.int64)
        self.at = np.concatenate([r[0] for r in rows]).astype(np.int32) if rows else np.empty(0, np.int32)
        self.value = np.concatenate([r[1] for r in rows]).astype(np.float32) if rows else np.empty(0, np.float32)
        self.of = np.repeat(np.arange(self.size, dtype=np.int32), self.lens)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.value * w[self.at], self.size)

    def back(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the weights, given that of each row's score."""
        return np.bincount(self.at, self.value * g[self.of], self.width)

    def only(self, at: np.ndarray) -> Rows:
        """The rows' features among ``at``, renumbered."""
        new = np.full(self.width, -1, np.int64)
        new[at] = np.arange(len(at))
        keep = new[self.at] >= 0
        out = Rows([], len(at))
        out.size, out.at, out.value, out.of = self.size, new[self.at[keep]], self.value[keep], self.of[keep]
        out.lens = np.bincount(out.of, minlength=self.size)
        return out

    def take(self, keep: np.ndarray) -> Rows:
        new, on = np.cumsum(keep) - 1, keep[self.of]
        out = Rows([], self.width)
        out.size, out.lens, out.at, out.value, out.of = int(keep.sum()), self.lens[keep], self.at[on], self.value[on], new[self.of[on]].astype(np.int32)
        return out


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


#: Features of a sample that come to the driver, some 12 bytes each there.
MOST_FEATURES = 4_000_000
#: Rows that a threshold lets through on average, as a multiple of those wanted: fewer than wanted is out of the question.
SPARE = 4


def bounded(rows: DataFrame, by: str, per: int, total: int, most: int = 200) -> DataFrame:
    """At most ``per`` keys for each value of ``by`` and ``total`` in all: those whose hash is lowest.

    rows has doc_id and ``by``; nulls of either and repeats don't count. Of more than ``most`` values the
    most frequent are taken, of equals the lesser. A threshold on the hash, set from how many keys a value
    has, cuts its rows before they are shuffled, so a frequent value is as little work as a rare one.
    """
    rows = rows.select("doc_id", by).where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    sizes = rows.groupBy(by).agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), by).limit(most).collect()
    if not sizes:
        return rows.limit(0)
    top = 2**63 - 1
    cuts = F.create_map(*(F.lit(x) for r in sizes for x in (r[0], top if r.n <= SPARE * per else top // r.n * SPARE * per)))
    at = F.xxhash64("doc_id").bitwiseAND(F.lit(top))
    few = rows.where(at <= F.element_at(cuts, F.col(by))).distinct()
    first = few.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(at, "doc_id"))).where(F.col("_n") <= per)
    return first.orderBy("_n", by, "doc_id").limit(total).drop("_n")


def sample_texts(docs: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, the columns and the text of the documents that a bounded table of keys names, as a table.

    keys is bounded by its maker, so it is broadcast. Of several texts with one doc_id the least counts,
    found in each task before the shuffle.
    """
    met = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")
    return written(met.groupBy("doc_id", *columns).agg(F.min("text").alias("text")), "sample")


def feature_counts(sample: DataFrame, vector, by: list[str]) -> DataFrame:
    """(at, by, n): how many texts of each group have the feature; at -1 counts all texts."""
    schema = pa.schema([("at", pa.int32()), *((c, pa.int32()) for c in by), ("n", pa.int64())])

    def run(batches):
        found: dict[tuple, np.ndarray] = {}
        for batch in slices(batches):
            for key, (at, _) in zip(zip(*(batch.column(c).to_pylist() for c in by), strict=True), vector.rows(batch), strict=True):
                n = found.setdefault(key, np.zeros(vector.width + 1, np.int64))
                n[at] += 1
                n[-1] += 1
        for key, n in found.items():
            at = np.flatnonzero(n)
            yield out_batch(schema, np.where(at == vector.width, -1, at), *([k] * len(at) for k in key), n[at])

    counted = map_arrow(sample.select("text", *by), run, "at int, " + ", ".join(f"{c} int" for c in by) + ", n long")
    return counted.groupBy("at", *by).agg(F.sum("n").alias("n"))


def gather_rows(sample: DataFrame, vector, columns: list[str], most: int = MOST_FEATURES):
    """(sparse rows, their values of ``columns``) of a sample of texts, for the driver.

    Where the rows have more than ``most`` features in all, those whose doc_id hashes lowest are taken up to that.
    """
    kinds = dict(sample.dtypes)

    def run(batches):
        for batch in slices(batches):
            rows = vector.rows(batch)
            value = [b"" if vector.ones else r[1].astype(np.float32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array(value, pa.binary()), pa.array([len(r[0]) for r in rows], pa.int64()), *(batch.column(c) for c in ("doc_id", *columns))], names=["at", "value", "n", "doc_id", *columns])

    table = written(map_arrow(sample, run, "at binary, value binary, n long, doc_id long" + "".join(f", {c} {kinds[c]}" for c in columns)), "features")
    order = F.xxhash64("doc_id")
    sizes = table.select(order.alias("h"), "n").orderBy("h").collect()  # as many rows as the sample's bound
    fits = np.searchsorted(np.cumsum([r.n for r in sizes]), most, "right")
    if fits < len(sizes):
        table = table.where(order < sizes[fits].h)
    found = table.collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.at)))
    at = [np.frombuffer(r.at, np.int32) for r in found]
    rows = Rows([(x, np.ones(len(x), np.float32) if vector.ones else np.frombuffer(r.value, np.float32)) for x, r in zip(at, found, strict=True)], vector.width)
    return rows, [tuple(r[c] for c in columns) for r in found]


_KINDS = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}


def score_rows(docs: DataFrame, vector, scores, columns: dict[str, str]) -> DataFrame:
    """Per row doc_id and what scores(sparse rows of a slice, the slice) returns, one list for each column."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, _KINDS[k]) for c, k in columns.items())])

    def run(batches):
        for batch in slices(batches):
            yield out_batch(schema, batch.column("doc_id"), *scores(Rows(vector.rows(batch), vector.width), batch))

    return map_arrow(docs, run, "doc_id long, " + ", ".join(f"{c} {k}" for c, k in columns.items()))


def select_rows(docs: DataFrame, vector, keep, text_col: str = "text") -> DataFrame:
    """The rows of which keep(sparse rows of a slice) is true, with all their columns; no shuffle."""
    text = free_name(docs, "_text")

    def run(batches):
        for batch in slices(batches, text):
            rows = Rows(vector.rows(pa.RecordBatch.from_arrays([batch.column(text)], names=["text"])), vector.width)
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep(rows), pa.bool_()))

    return map_arrow(docs.withColumn(text, F.col(text_col).cast("string")), run, docs.schema)
