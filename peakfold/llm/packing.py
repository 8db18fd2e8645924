"""Packing token sequences: vector bin packing by dot products, under three limits at once.

A bin has so many tokens, segments and loss-bearing tokens left. The next piece is the pooled item
whose demand has the largest dot product with what is left, each limit taken as 1; where none fits
whole, the best one is cut to what fits. A bin that can't be filled ends at a power of two, which is
stored unpadded; what is beyond goes back to the pool. So no sequence holds padding.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from peakfold.llm.common import IdMemo, id_text, map_arrow, out_batch, shipped_file, slices, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Limits of a sequence: tokens, segments, and of its tokens those that bear loss.
TOKENS, SEGMENTS, LOSS = 4096, 256, 3968
#: Items to choose from; a task holds no more than these and the documents of a slice.
POOL = 1024


class Item:
    __slots__ = ("key", "ids", "start", "end", "loss")

    def __init__(self, key, ids, loss=None, start=0, end=None):
        """loss: running count of loss-bearing tokens, one entry more than ids; None: all are."""
        self.key, self.ids, self.loss, self.start, self.end = key, ids, loss, start, len(ids) if end is None else end

    def demand(self) -> tuple[int, int, int]:
        n = self.end - self.start
        return n, 1, n if self.loss is None else int(self.loss[self.end] - self.loss[self.start])

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit."""
        n = min(tokens, self.end - self.start)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1 - self.start)

    def cut(self, n: int) -> tuple[Item, Item]:
        m = self.start + n
        return Item(self.key, self.ids, self.loss, self.start, m), Item(self.key, self.ids, self.loss, m, self.end)


class Packer:
    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, pool: int = POOL):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits are at least 1")
        self.limits, self.size = np.array([tokens, segments, loss], np.float64), pool
        self.items: list[Item] = []
        self.demands = np.zeros((0, 3))

    def add(self, items: list[Item]) -> None:
        items = [x for x in items if x.end > x.start]
        if items:
            self.items += items
            self.demands = np.concatenate([self.demands, np.array([x.demand() for x in items], np.float64)])

    def _take(self, k: int) -> Item:
        """Removes item k; the last one moves to its place."""
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k] = last
            self.demands[k] = self.demands[-1]
        self.demands = self.demands[:-1]
        return item

    def bin(self) -> list[Item]:
        """The next sequence's pieces."""
        left, pieces, limit = self.limits.copy(), [], int(self.limits[0])
        while self.items and left.min() >= 1:
            score = self.demands @ (left / self.limits**2)
            fits = (self.demands <= left).all(axis=1)
            if fits.any():
                item = self._take(int(np.argmax(np.where(fits, score, -1.0))))
            else:
                k = int(np.argmax(score))
                n = self.items[k].fitting(int(left[0]), int(left[2]))
                if n < 1:
                    break
                item, rest = self._take(k).cut(n)
                self.add([rest])
            pieces.append(item)
            left -= item.demand()
        total = sum(x.end - x.start for x in pieces)
        if total < limit:
            goal = 1 << total.bit_length() - 1
            while total > goal:
                x = pieces.pop()
                n = x.end - x.start
                if total - n < goal:
                    x, rest = x.cut(goal - total + n)
                    pieces.append(x)
                    self.add([rest])
                    break
                self.add([x])
                total -= n
        return pieces

    def feed(self, items: list[Item]):
        """Takes items in; yields full sequences while the pool is large enough to choose from."""
        self.add(items)
        while len(self.items) > self.size:
            yield self.bin()

    def rest(self):
        while self.items:
            yield self.bin()


#: Texts of these characters alone are cut into the words that the tokenizer's own pattern makes of them.
PLAIN = re.compile(r"[\t\n\r -~À-ÿ]*")
#: That pattern over lower-case text of these characters, and the mark of a word's last id.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~×÷]+")
WORD_END = "</w>"
#: Words that the library gets as one text.
JOINED = 256


def cut_text(text: str) -> list[str]:
    """Pieces whose ids, end to end, are the text's: words where the text is plain, else what blanks divide.

    Added tokens have a "<|", so a text with one is cut at blanks only.
    """
    if "<|" not in text and PLAIN.fullmatch(text):
        return WORDS.findall(text.lower())
    return text.split(" ")


def tokenizer_memo(path: str) -> IdMemo:
    """Ids of pieces by the tokenizers library, for a tokenizer that lower-cases and whose words end at blanks.

    Words are encoded many to a text: each has one id that ends a word, which is where they are told apart.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    vocab = t.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        words = [k for k, p in enumerate(pieces) if WORDS.fullmatch(p)]
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for group, ids in zip(groups, encode([" ".join(pieces[k] for k in g) for g in groups]), strict=True):
            cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                for k, a, b in zip(group, [0, *cuts], cuts):  # noqa: B905
                    out[k] = ids[a:b]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, encode([pieces[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    return IdMemo(encode_many)


class Bearing:
    """Marks the ids that bear loss, by a table over the vocabulary."""

    def __init__(self, bears: np.ndarray):
        self.bears = bears

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.bears[np.minimum(ids, len(self.bears) - 1)]


def word_mask(path: str, end_id: int = 2) -> Bearing:
    """Words and numbers bear loss; marks, lone signs and the end id, which is fixed by the format, don't."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    bears = np.zeros(max(*vocab.values(), end_id) + 1, bool)
    bears[[i for token, i in vocab.items() if any(c.isalnum() for c in token.removesuffix(WORD_END))]] = True
    bears[end_id] = False
    return Bearing(bears)


_memos: dict[str, IdMemo] = {}


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, id_col: str = "doc_id", text_col: str = "text", loss_mask=None) -> DataFrame:
    """Per piece: doc_id, start, length, CRC-32 of its ids, doc_tokens, sequence_id, offset.

    Each task packs its own rows: no shuffle, no group that could be hot. A sequence's number is the
    task's partition and a count, the same if the task runs again. loss_mask(ids) marks loss-bearing
    tokens of a document (default: all of them); a sequence has at most ``loss`` of them. tokenizer is a
    file of the driver; the executors get it. A row without text, or without any token, is the end id
    alone; a text of any length is packed whole, in pieces; repeated rows and null keys are documents of
    their own; other columns are not looked at; an empty table gives no piece. Of pieces that fit equally
    well the one longest in its place in the pool is next.
    """
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    file = shipped_file(docs.sparkSession, tokenizer, "tokenizer")

    def run(batches):
        if (path := file.path()) not in _memos:
            _memos[path] = tokenizer_memo(path)
        memo, packer, number = _memos[path], Packer(tokens, segments, loss), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal number
            at = 0
            for x in pieces:
                raw = x.ids[x.start : x.end].astype("<u4").tobytes()
                rows.append((x.key, x.start, x.end - x.start, zlib.crc32(raw), len(x.ids), number, at))
                at += x.end - x.start
            number += 1

        for batch in slices(batches):
            keys, ids = batch.column("doc_id").to_pylist(), memo.ids([cut_text(t) for t in texts_of(batch)])
            for key, x in zip(keys, ids, strict=True):
                x = np.append(x, np.uint32(end_id))
                running = None if loss_mask is None else np.concatenate([[0], np.cumsum(loss_mask(x))])
                items = [Item(key, x, running)]
                while items[0].end - items[0].start > tokens and items[0].fitting(tokens, loss) == tokens:
                    full, items[0] = items[0].cut(tokens)
                    emit([full])
                for pieces in packer.feed(items):
                    emit(pieces)
            if rows:
                yield out_batch(schema, *map(list, zip(*rows, strict=True)))
                rows.clear()
        for pieces in packer.rest():
            emit(pieces)
        if rows:
            yield out_batch(schema, *map(list, zip(*rows, strict=True)))

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA)
