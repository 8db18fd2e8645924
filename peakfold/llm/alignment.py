"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

Each byte's owner in A and in B stands in an array; where the pair of owners changes, two tokens overlap
anew, and where both change at once, both tokenizers cut. Tokens between two such cuts are a group, and
every A token of a group is linked with every B token of it.

Counts go by blocks of rows: a block has its rows' distinct id pairs once, so a common pair meets the
corpus-wide counts once a block and not once a row, and what a block gets back is as large as the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm import bpe
from peakfold.llm.common import IdMemo, Ship, id_text, map_arrow, scratch, shipped_file, slices, texts_of, written

#: Bytes whose owners stand in arrays at a time.
WINDOW = 1 << 20
#: Pairs of a row, together with those of the rows before it, at which a block ends.
BLOCK_PAIRS = 400_000
#: Links that are made in one step, and links of one group from which on its distinct ids are paired instead.
STEP_LINKS, WIDE_GROUP = 2_000_000, 4096


class Pieces:
    """Tokens of a SentencePiece BPE model for text after a blank; pieces between blanks are encoded once."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.token_bytes = [bytes([int(n[3:-1], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.blank = sp.piece_to_id("▁")
        #: No token goes on after a blank that follows other characters, so what stands between blanks is on its own.
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self.memo = IdMemo(self._encode)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        found = iter(self.sp.encode([p for p in pieces if p], num_threads=1))
        return [next(found) if p else [self.blank] for p in pieces]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before each run of blanks, the run's first blank left out, as the model puts one before what it gets."""
        words = text.split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for w in words:
            if w:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        if run:
            out.append(" " * (run - 1))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(i, np.uint32) for i in self.sp.encode(texts, num_threads=1)]
        return self.memo.ids([self.pieces(t) if t else [] for t in texts])


def owners(lens: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """The token of each byte from low to high."""
    a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left")) + 1
    stop = ends[a:b]
    return np.repeat(np.arange(a, min(b, len(lens))), np.minimum(stop, high) - np.maximum(stop - lens[a:b], low))


def overlay(lens_a: np.ndarray, lens_b: np.ndarray, window: int = WINDOW):
    """lens: bytes of each token, none empty, with equal sums. (overlaps in A, overlaps in B, group of each A token, of each B token).

    An overlap is a pair of tokens that have a byte in common, in order. A window's bytes have owner arrays at a time.
    """
    ends_a, ends_b = np.cumsum(lens_a), np.cumsum(lens_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    over_a, over_b, group_a, group_b = [], [], [], []
    last_a = last_b = group = -1
    for low in range(0, total, window):
        high = min(total, low + window)
        own_a, own_b = owners(lens_a, ends_a, low, high), owners(lens_b, ends_b, low, high)
        new_a, new_b = np.diff(own_a, prepend=last_a) != 0, np.diff(own_b, prepend=last_b) != 0
        at = np.flatnonzero(new_a | new_b)
        over_a.append(own_a[at])
        over_b.append(own_b[at])
        number = group + np.cumsum(new_a & new_b)
        group_a.append(number[new_a])
        group_b.append(number[new_b])
        last_a, last_b, group = own_a[-1], own_b[-1], number[-1]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(over_a), join(over_b), join(group_a), join(group_b)


def linked(ids_a, ids_b, group_a, group_b, row_of, rows: int, size_b: int):
    """(row, code, occurrences) of each row's distinct id pairs that are linked; a code is A's id times size_b, and B's id.

    row_of: the row of each group. Links of ordinary groups are made one by one, in steps of bounded size; of
    a wide group only its distinct ids are paired, with the product of their occurrences.
    """
    groups = len(row_of)
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    space = np.int64(int(ids_a.max(initial=0)) + 1) * size_b
    keys, counts = [], []

    def take(key, n):
        distinct, back = np.unique(key, return_inverse=True)
        keys.append(distinct)
        counts.append(np.bincount(back, weights=n, minlength=len(distinct)).astype(np.int64) if n is not None else np.bincount(back, minlength=len(distinct)))

    usual = np.where(links <= WIDE_GROUP)[0]
    steps = np.cumsum(links[usual]) // STEP_LINKS
    for part in np.split(usual, np.flatnonzero(np.diff(steps)) + 1):
        per = n_a[part]
        a = np.repeat(first_a[part] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        width = n_b[group_a[a]]
        left = np.repeat(a, width)
        right = np.repeat(first_b[group_a[a]] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        take(row_of[group_a[left]] * space + ids_a[left].astype(np.int64) * size_b + ids_b[right], None)
    for g in np.flatnonzero(links > WIDE_GROUP):
        u, m = np.unique(ids_a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        v, n = np.unique(ids_b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        step = max(1, STEP_LINKS // len(v))
        for k in range(0, len(u), step):
            take((row_of[g] * space + u[k : k + step, None].astype(np.int64) * size_b + v[None, :]).ravel(), (m[k : k + step, None] * n[None, :]).ravel())
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key // space, key % space, np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


class Aligner:
    """Tokens of A for a blank and the text, of B for the text, and their groups."""

    def __init__(self, tokenizer: str, lexicon: str, newer: str, model: str):
        self.a = bpe.Encoder(bpe.Vocabulary(tokenizer), bpe.Lexicon.map(lexicon), newer)
        self.a.special = None  # their strings are plain text
        self.b = Pieces(model)
        self.bytes_a, self.bytes_b = self.a.vocabulary.token_bytes, self.b.token_bytes
        self.lens_a, self.lens_b = (np.array([len(x or b"") for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: A token's decimal id behind each mark; the first token of a row has none.
        self.names = [f"{mark}{i}".encode() for mark in ("", ";", "|", ",") for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.wide = len(self.names) // 4

    def tokens(self, texts: list[str]):
        """Per text its ids of A and B; none where there is no text or its tokens' bytes aren't its own."""
        none = np.zeros(0, np.uint32)
        out = []
        for t, a, b in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts), strict=True):
            raw = b" " + t.encode()
            same = t and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw
            out.append((a, b) if same else (none, none))
        return out

    def align(self, texts: list[str]) -> dict:
        """All texts as one stream of bytes; both tokenizers cut between texts."""
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.uint32), *(t[k] for t in tokens)]).astype(np.int64) for k in (0, 1))
        over_a, over_b, group_a, group_b = overlay(self.lens_a[ids_a], self.lens_b[ids_b])
        rows = np.repeat(np.arange(len(texts)), n_a)
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        row_of = np.zeros(groups, np.int64)
        row_of[group_a] = rows
        return {"n_a": n_a, "n_b": n_b, "ids_a": ids_a, "ids_b": ids_b, "group_a": group_a, "group_b": group_b, "over_a": over_a, "over_b": over_b, "row_of": row_of, "n_groups": np.bincount(row_of, minlength=len(texts))}

    def digests(self, x: dict) -> list[str]:
        """The SHA-256 of each row's groups as text; empty without tokens."""
        ids_a, ids_b, group_a, group_b = x["ids_a"], x["ids_b"], x["group_a"], x["group_b"]
        groups = len(x["row_of"])
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        new_a, new_b = np.diff(group_a, prepend=-1) != 0, np.diff(group_b, prepend=-1) != 0
        out[np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]] = ids_a + self.wide * np.where(new_a, 1, 3)
        out[np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]] = ids_b + self.wide * np.where(new_b, 2, 3)
        n = x["n_a"] + x["n_b"]
        start = np.cumsum(n) - n
        out[start[n > 0]] -= self.wide
        names = self.names
        return [hashlib.sha256(b"".join([names[i] for i in out[s : s + k].tolist()])).hexdigest() if k else "" for s, k in zip(start.tolist(), n.tolist(), strict=True)]


_aligners: dict[tuple, Aligner] = {}


def shipped(spark, tokenizer: str, model: str):
    """A function that gives a worker its aligner; the files go to the executors."""
    file, pieces, newer = shipped_file(spark, tokenizer, "tokenizer"), shipped_file(spark, model, "pieces"), bpe.newer_letters()
    lexicon = Ship(spark, bpe.vocabulary_lexicon(bpe.Vocabulary(tokenizer)).dump(), "bpe-lexicon")

    def get() -> Aligner:
        key = (file.path(), lexicon.path(), pieces.path())
        if key not in _aligners:
            _aligners[key] = Aligner(key[0], key[1], newer, key[2])
        return _aligners[key]

    return get


def align_documents(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids_a, ids_b, group_a and group_b (the group of each token, from 0), and overlaps (a, b: places of tokens
    that have a byte in common). Odd rows as in link_documents()."""
    get = shipped(docs.sparkSession, tokenizer, model)
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids_a", "ids_b", "group_a", "group_b")), ("overlaps", pa.list_(pair))])

    def run(batches):
        aligner = get()
        for batch in slices(batches):
            x = aligner.align(texts_of(batch))
            base_a, base_b, base_g = np.cumsum(x["n_a"]) - x["n_a"], np.cumsum(x["n_b"]) - x["n_b"], np.cumsum(x["n_groups"]) - x["n_groups"]
            row = x["row_of"][x["group_a"]][x["over_a"]]
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            rows = []
            for k in range(batch.num_rows):
                a, b = slice(base_a[k], base_a[k] + x["n_a"][k]), slice(base_b[k], base_b[k] + x["n_b"][k])
                over = [{"a": int(p - base_a[k]), "b": int(q - base_b[k])} for p, q in zip(x["over_a"][cut[k] : cut[k + 1]], x["over_b"][cut[k] : cut[k + 1]], strict=True)]
                rows.append([x["ids_a"][a], x["ids_b"][b], x["group_a"][a] - base_g[k], x["group_b"][b] - base_g[k], over])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True))], schema=schema)

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, ids_a array<long>, ids_b array<long>, group_a array<long>, group_b array<long>, overlaps array<struct<a: long, b: long>>")


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = "block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _COUNTS) + ", groups_sha256 array<string>, pairs array<int>, code array<long>, rows array<int>, place binary, occurrences binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in _COUNTS), ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int32())), ("code", pa.list_(pa.int64())), ("rows", pa.list_(pa.int32())), ("place", pa.binary()), ("occurrences", pa.binary())])


class _Block:
    """Rows that are gathered until they have many pairs."""

    def __init__(self):
        self.parts: dict[str, list] = {c: [] for c in ("doc_id", *_COUNTS, "groups_sha256", "pairs")}
        self.codes, self.occurrences, self.size = [], [], 0

    def batch(self, number: int) -> pa.RecordBatch:
        """Distinct codes with the number of rows that have each; per row the places of its codes among these."""
        codes = np.concatenate(self.codes)
        distinct, place, rows = np.unique(codes, return_inverse=True, return_counts=True)
        pack = zstandard.ZstdCompressor(1).compress
        values = [[number], *([self.parts[c]] for c in self.parts), [distinct], [rows.astype(np.int32)], [pack(place.astype("<u4").tobytes())], [pack(np.concatenate(self.occurrences).astype("<i8").tobytes())]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _BLOCK_SCHEMA.types, strict=True)], schema=_BLOCK_SCHEMA)


def blocks(docs: DataFrame, tokenizer: str, model: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Rows (doc_id, text) in blocks, each with its rows' figures and id pairs."""
    get = shipped(docs.sparkSession, tokenizer, model)

    def run(batches):
        aligner, block, number = get(), _Block(), TaskContext.get().partitionId() << 32
        size_b = len(aligner.bytes_b)
        for batch in slices(batches):
            x = aligner.align(texts_of(batch))
            n = batch.num_rows
            row, code, times = linked(x["ids_a"], x["ids_b"], x["group_a"], x["group_b"], x["row_of"], n, size_b)
            x["n_links"] = np.bincount(row, weights=times, minlength=n).astype(np.int64)
            pairs = np.bincount(row, minlength=n)
            block.parts["doc_id"] += batch.column("doc_id").to_pylist()
            for c in _COUNTS:
                block.parts[c] += x[c].tolist()
            block.parts["groups_sha256"] += aligner.digests(x)
            block.parts["pairs"] += pairs.tolist()
            block.codes.append(code)
            block.occurrences.append(times)
            block.size += len(code)
            if block.size >= block_pairs:
                yield block.batch(number)
                block, number = _Block(), number + 1
        if block.parts["doc_id"]:
            yield block.batch(number)

    return map_arrow(docs, run, BLOCKS)


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _answered(block: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's rows with the corpus-wide figures of their pairs."""
    out = []
    for b in block.to_batches():
        for k in range(b.num_rows):
            col = {c: b.column(c)[k].values if pa.types.is_list(b.schema.field(c).type) else b.column(c)[k].as_py() for c in b.schema.names}
            count, best = (np.zeros(len(col["code"]), np.int64) for _ in range(2))
            at = answers.column("k").to_numpy()
            count[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
            place, times = (np.frombuffer(zstandard.ZstdDecompressor().decompress(col[c]), t) for c, t in (("place", "<u4"), ("occurrences", "<i8")))
            row = np.repeat(np.arange(len(col["pairs"])), col["pairs"].to_numpy())
            sums = [np.zeros(len(col["pairs"]), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * best[place])
            np.add.at(sums[1], row, times * count[place])
            out.append(pa.RecordBatch.from_arrays([col["doc_id"], *(col[c] for c in _COUNTS), *map(pa.array, sums), col["groups_sha256"]], schema=_RESULT))
    return pa.Table.from_batches(out, _RESULT)


def link_documents(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    tokenizer (byte-level) and model (SentencePiece) are files of the driver; the executors get them. A row
    without text, or whose tokens' bytes aren't those of a blank and the text, has no tokens: zeros, and an
    empty digest; it counts nowhere. Texts of any length are taken whole; the owners of a window of bytes
    stand in arrays at a time. Repeated rows and rows with null keys are documents of their own, and count so;
    ties for an A id's highest count are all best. An empty table gives no rows; other columns are not looked at.
    """
    size_b = len(Pieces(model).token_bytes)
    with scratch(docs.sparkSession):
        table = written(blocks(id_text(docs, id_col, text_col), tokenizer, model, block_pairs), "align-blocks", keep=True)
        each = table.select("block", F.posexplode(F.arrays_zip("code", "rows")).alias("k", "p")).select("block", "k", "p.code", "p.rows")
        totals = written(each.groupBy("code").agg(F.sum("rows").alias("n")).withColumn("a", F.expr(f"code div {size_b}")), "align-totals", keep=True)
    highest = totals.groupBy("a").agg(F.max("n").alias("top"))  # a row an id of A's vocabulary at most
    judged = totals.join(F.broadcast(highest), "a").select("code", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    answers = each.drop("rows").join(judged, "code").select(F.col("block").alias("of"), "k", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return table.drop("rows").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_answered, schema)
