"""Importance resampling towards a target distribution, by hashed counts of word runs.

Runs of words are paths of a trie that each task holds for its own rows: a node has its run's count and
the CRC state of the run's bytes, so a longer run goes on from its parent's state. Counts leave a task as
totals by bucket. Scoring walks such tries again, with each bucket's gain attached to the nodes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import bytes_of, id_text, map_arrow, out_batch, scratch, slices, written

#: Bytes of a word after lower-casing A-Z; others stand between words.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Nodes at which a task's trie gives its counts to the bucket totals and begins anew.
MOST_NODES = 1_000_000
#: Scores that are summed together when ranks are given out.
BLOCK = 512


class Trie:
    """Paths of words from the root; ``gains`` gives each bucket's gain to the nodes."""

    def __init__(self, buckets: int, words: int = 1, gains: np.ndarray | None = None):
        self.buckets, self.words, self.gains = buckets, words, gains
        self.totals = np.zeros(buckets, np.int64)
        self._new()

    def _new(self) -> None:
        self.first: dict[bytes, int] = {}  # words at the root; a word's number is its node there
        self.text: list[bytes] = []
        self.arcs: dict[int, int] = {}  # node << 32 | word: node, below the first level
        self.crc, self.count, self.gain = [], np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.number: dict[int, int] = {}

    def _add(self, state: int) -> int:
        node = len(self.crc)
        self.crc.append(state)
        if node == len(self.count):
            self.count, self.gain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.gain))
        if self.gains is not None:
            self.gain[node] = self.gains[state % self.buckets]
        return node

    def _word(self, word: bytes) -> int:
        node = self.first[word] = self._add(zlib.crc32(word))
        if self.words > 1:
            self.number[node] = len(self.text)
            self.text.append(word)
        return node

    def flush(self) -> None:
        """Adds the nodes' counts to the buckets' totals and drops the nodes."""
        n = len(self.crc)
        np.add.at(self.totals, np.array(self.crc, np.int64) % self.buckets, self.count[:n])
        self._new()

    def walk(self, raws: list[bytes]):
        """(text number, node) arrays of each level: all runs of as many words as the level is deep."""
        if len(self.crc) > MOST_NODES:
            self.flush()
        split = [raw.lower().translate(_WORD_BYTES).split() for raw in raws]
        get, add = self.first.get, self._word
        nodes = np.fromiter((n if (n := get(w)) is not None else add(w) for ws in split for w in ws), np.int64)
        owner = np.repeat(np.arange(len(raws)), [len(ws) for ws in split])
        yield owner, nodes
        if self.words < 2:
            return
        number = np.fromiter(map(self.number.__getitem__, nodes.tolist()), np.int64, len(nodes))
        for depth in range(1, self.words):
            same = owner[depth:] == owner[: len(owner) - depth]
            keys = (nodes[: len(same)][same] << 32) | number[depth:][same]
            distinct, back = np.unique(keys, return_inverse=True)
            found = np.empty(len(distinct), np.int64)
            for k, key in enumerate(distinct.tolist()):
                if (node := self.arcs.get(key)) is None:
                    node = self.arcs[key] = self._add(zlib.crc32(b" " + self.text[key & 0xFFFFFFFF], self.crc[key >> 32]))
                found[k] = node
            below = np.full(len(same), -1, np.int64)
            below[same] = found[back]
            yield owner[: len(same)][same], below[same]
            nodes = below

    def add(self, raws: list[bytes]) -> None:
        for _, nodes in self.walk(raws):
            counts = np.bincount(nodes, minlength=len(self.count))
            self.count[: len(counts)] += counts

    def score(self, raws: list[bytes]):
        """Per text: words, runs, and the sum of the runs' gains."""
        words, runs, total = (np.zeros(len(raws), np.int64) for _ in range(3))
        for depth, (owner, nodes) in enumerate(self.walk(raws)):
            n = np.bincount(owner, minlength=len(raws))
            runs += n
            np.add.at(total, owner, self.gain[nodes])
            words = words if depth else n
        return words, runs, total


def bucket_counts(docs: DataFrame, buckets: int, words: int = 1) -> DataFrame:
    """(bucket, n) over all rows of doc_id, text; each task gives its totals alone."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches):
        trie = Trie(buckets, words)
        for batch in slices(batches):
            trie.add(bytes_of(batch))
        trie.flush()
        at = np.flatnonzero(trie.totals)
        yield out_batch(schema, at, trie.totals[at])

    return map_arrow(docs, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the logarithm of its smoothed share in the target over that in the source."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    out = [math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array(out, np.int64)


def _totals(counts: DataFrame, buckets: int) -> np.ndarray:
    """A row a bucket at most, so the driver's share is fixed by the number of buckets."""
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def weighed(docs: DataFrame, gain: np.ndarray, words: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains over a text's runs, 0 without any."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches):
        trie = Trie(len(gain), words, gain)
        for batch in slices(batches):
            n, runs, total = trie.score(bytes_of(batch))
            yield out_batch(schema, batch.column("doc_id"), n, runs, np.where(runs > 0, total // np.maximum(runs, 1), 0))

    return map_arrow(docs, run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, doc_id: Column) -> Column:
    """A thousandth-floored Gumbel draw that depends on seed and doc_id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, words: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank; rank is null for rows that aren't drawn.

    Of the rows with ``least_words`` words, ``percent`` in a hundred (floored) with the highest scores are
    drawn, of equal scores the smaller doc_ids. Null and empty texts have no runs and a weight of 0; texts
    count whole. Repeated rows count, and are drawn, as often as they occur, in any order among
    themselves; null keys have one draw in common and come first of equal scores. Without rows, or target
    texts, counts are 0: nothing is drawn, or all gains come from smoothing. Other columns are not looked at.

    Ranks need no order over all rows: a score is a whole number out of some ten thousands, so counts by
    score give each score's first rank, and only rows of one score stand in order together.
    """
    rows = id_text(docs, id_col, text_col)
    goal = target.select(F.lit(0).cast("long").alias("doc_id"), F.col(target_col).cast("string").alias("text"))
    gain = gains(_totals(bucket_counts(rows, buckets, words), buckets), _totals(bucket_counts(goal, buckets, words), buckets))
    scored = weighed(rows, gain, words).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn("long_enough", F.col("n_words") >= least_words).drop("n_words")
    with scratch(docs.sparkSession):
        kept = written(scored, "resample-scored", keep=True)
        counts = kept.where("long_enough").groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
        counts = written(counts, "resample-counts")
        blocks = counts.groupBy("block").agg(F.sum("n").alias("bn"))
        higher = F.coalesce(F.sum("bn").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # some hundred blocks
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        drawn = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
        first = counts.join(blocks.withColumn("higher", higher).drop("bn"), "block").withColumn("above", F.col("higher") + inside).where(F.col("above") < drawn)
        first = written(first.select("score", "above"), "resample-first", keep=True)
    seen = kept.join(first, "score", "left").withColumn("asked", F.col("long_enough") & F.col("above").isNotNull())
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id")))
    high = seen.where("asked").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    low = seen.where("not asked").withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return high.select(*columns).unionByName(low.select(*columns))
