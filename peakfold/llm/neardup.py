"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Each of several independent trees sends a document
from node to node: a node's own hash chooses minwise tokens, and documents with the same token go to
the same child. A node of few documents compares them all. A larger one compares each with a pivot;
when its documents are then in one component it is done, when few comparisons are left (those outside
the largest component against all) they are made, and else it branches on. Candidates are kept or dropped by minwise sketches, or in larger nodes by the sets' lowest
hashes, with a wide margin, and links are confirmed on full sets. Components are those of the confirmed
links, which is why links inside one component needn't be looked for.
"""

from __future__ import annotations

import functools
import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import bytes_of, free_name, id_text, map_arrow, out_batch, scratch, slices, written
from peakfold.llm.components import components

#: Tokens of a sketch, first and last depth, documents of a small node, comparisons
#: up to which a larger node ends, documents of a block in which these are made, and their lowest hashes
#: by which they are compared there.
WIDTH, DEPTH, MOST_DEPTH, SMALL, WORK, BLOCK, LOWEST = 128, 3, 12, 32, 2_000_000, 256, 256
#: Left blocks, and documents, of a node that share a key; a larger node is dealt over several keys.
SALT_BLOCKS, SALT_ROWS = 8, 4096
#: Second children a node has on average, as a multiple of those by which a pair at the threshold survives a
#: level once; the chance up to which such a pair may be in no leaf of any tree, at the last depth too.
SPARE, MISS = 1.5, 0.001
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _A
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def extra(percent: int) -> float:
    """Second children a node has on average; at most each node has one."""
    return min(SPARE * (100 / percent - 1), 1.0)


def missed(percent: int, trees: int, depth: int) -> float:
    """The chance that a pair at the threshold is together in no node of that depth.

    All trees draw from one sketch, so the chance is taken over how many of its tokens the pair shares.
    """
    x, second = np.arange(WIDTH + 1) / WIDTH, extra(percent)
    gone = np.zeros(WIDTH + 1)
    for _ in range(depth - DEPTH):
        child = 1 - x + x * gone
        gone = child * (1 - second + second * child)
    shares = np.array([float(comb(WIDTH, k)) for k in range(WIDTH + 1)]) * (percent / 100) ** (x * WIDTH) * (1 - percent / 100) ** (WIDTH - x * WIDTH)
    return float((shares * (1 - x**DEPTH * (1 - gone)) ** trees).sum())


@functools.cache
def trees(percent: int) -> int:
    """Trees by which a pair at the threshold is missed with a chance of MISS at most, at any depth."""
    return next(n for n in range(1, 1000) if missed(percent, n, MOST_DEPTH) <= MISS)


class WordHash(dict):
    LIMIT = 200_000  # some 40 MB a worker

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHash()


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z in lower case, words between ASCII white space."""
    w = raw.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = mix(s ^ h[k : len(h) - n + 1 + k])
    return np.unique(s)


#: For each bin all bins' places in an order of its own.
_ORDER = mix(np.arange(WIDTH * WIDTH, dtype=np.uint64)).reshape(WIDTH, WIDTH).argsort(axis=1).argsort(axis=1).astype(np.uint8)


def sketch(s: np.ndarray) -> np.ndarray:
    """One-permutation minwise tokens of a set; an empty bin takes that of the full one first in the bin's own order.

    So a small set's bins are as good as independent: one more shingle takes its share of the empty bins
    one by one, not all those before its own.
    """
    edges = np.arange(WIDTH, dtype=np.uint64) << np.uint64(64 - WIDTH.bit_length() + 1)
    at = np.searchsorted(s, edges)
    has = np.diff(at, append=len(s)) > 0
    if not has.all():
        full, empty = np.flatnonzero(has), np.flatnonzero(~has)
        at[empty] = at[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return (s[at] >> np.uint64(16)).astype(np.uint32)


def lowest(s: np.ndarray) -> np.ndarray:
    """The upper halves of a set's lowest hashes."""
    return (s[:LOWEST] >> np.uint64(32)).astype(np.uint32)


def spread(percent: int) -> float:
    """The standard error of a similarity at the threshold, estimated from one hash."""
    return float(np.sqrt(percent / 100 * (1 - percent / 100)))


def near_enough(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches let a pair reach the similarity, four standard errors allowed for."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    least = percent / 100 - 4 * spread(percent) / np.sqrt(WIDTH * -np.expm1(-low / WIDTH))  # bins that are not empty
    return (100 * low >= percent * high) & ((a == b).mean(axis=-1) >= least)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def _ints(column) -> np.ndarray:
    return np.asarray(column, np.int64)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def first_nodes(s: np.ndarray, n: int) -> list[np.ndarray]:
    """The nodes at the first depth of each sketch (a row of s), for each of n trees."""
    rows, out = np.arange(len(s)), []
    for tree in range(n):
        node = mix(np.full(len(s), tree + 1, np.uint64))
        for _ in range(DEPTH):
            node = mix(node ^ s[rows, (mix(node) % np.uint64(WIDTH)).astype(np.int64)])
        out.append(node)
    return out


def _first_nodes(reps: DataFrame, percent: int) -> DataFrame:
    """(node, id) for each tree, at the first depth: the root and the levels above would hold too much of a corpus."""
    schema = pa.schema([("node", pa.int64()), ("id", pa.int64())])
    n = trees(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, ids = first_nodes(_sketches(batch.column("sketch")), n), _ints(batch.column("id"))
            yield out_batch(schema, np.concatenate(nodes).view(np.int64), np.tile(ids, n))

    return map_arrow(reps.select("id", "sketch"), run, "node long, id long")


def _children(rows: DataFrame, percent: int) -> DataFrame:
    """rows: node, id, sketch. The node alone chooses the tokens, so similar documents stay together."""
    schema = pa.schema([("node", pa.int64()), ("id", pa.int64())])
    second = np.uint64(min(int(extra(percent) * 2**64), 2**64 - 1))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s, ids, rows, node = _sketches(batch.column("sketch")), _ints(batch.column("id")), np.arange(batch.num_rows), _ints(batch.column("node")).view(np.uint64)
            pick = lambda salt: s[rows, (mix(node ^ np.uint64(salt)) % np.uint64(WIDTH)).astype(np.int64)]
            more = mix(node ^ np.uint64(5)) < second
            yield out_batch(schema, np.concatenate([mix(node ^ pick(1)), mix(node + _A ^ pick(2))[more]]).view(np.int64), np.concatenate([ids, ids[more]]))

    return map_arrow(rows.select("node", "id", "sketch"), run, "node long, id long")


def _small_pairs(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of nodes with few documents; equal nodes of several trees count once."""
    groups = rows.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    members = groups.select(F.xxhash64("ids").alias("g"), F.explode("ids").alias("id")).join(reps.select("id", "n", "sketch"), "id")
    lists = members.groupBy("g").agg(F.collect_list(F.struct("id", "n", "sketch")).alias("m")).select("m")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("m")
            ends = np.cumsum([0, *(len(x) for x in column)])
            flat = column.flatten()
            ids, n, s = _ints(flat.field("id")), _ints(flat.field("n")), _sketches(flat.field("sketch"))
            left, right = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                i, j = np.triu_indices(b - a, 1)
                i, j = i + a, j + a
                ok = near_enough(s[i], s[j], n[i], n[j], percent)
                left.append(ids[i[ok]])
                right.append(ids[j[ok]])
            left, right = np.concatenate(left), np.concatenate(right)
            yield out_batch(_PAIRS, np.minimum(left, right), np.maximum(left, right))

    return map_arrow(lists, run, "a long, b long")


def _pair_filter(rows: DataFrame, percent: int) -> DataFrame:
    """rows: a, b, na, nb, sa, sb. Those whose sketches are near enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _ints(batch.column("a")), _ints(batch.column("b"))
                ok = near_enough(_sketches(batch.column("sa")), _sketches(batch.column("sb")), _ints(batch.column("na")), _ints(batch.column("nb")), percent) & (a != b)
                yield out_batch(_PAIRS, np.minimum(a, b)[ok], np.maximum(a, b)[ok])

    return map_arrow(rows.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long")


def _star_pairs(big: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """big: node, id, pivot. Each document with its node's pivot."""
    pairs = big.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    one = lambda k: reps.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    return _pair_filter(pairs.join(one("a"), "a").join(one("b"), "b"), percent)


def _blocks(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """marked: node, id, component, top, size. Pairs (l, r) of blocks of bounded size that meet in a node; l is
    outside the node's largest component (top)."""
    rows = marked.join(sets.select("id", "n", "low"), "id").withColumn("few", F.col("component") != F.col("top"))
    block = F.pmod(F.xxhash64("id", "node"), F.col("size").cast("long") / BLOCK + 1).cast("long")
    lists = rows.groupBy("node", "size", "few", block.alias("block")).agg(F.collect_list(F.struct("id", "n", "low", "component")).alias("m"))
    salts = F.expr(f"1 + size div {BLOCK * SALT_BLOCKS}")  # a large node's left blocks go to as many keys; each has all right ones
    left = lists.where("few").select("node", F.pmod("block", salts).alias("salt"), F.col("block").alias("lb"), F.col("m").alias("l"))
    right = lists.select("node", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).alias("salt"), "few", "block", F.col("m").alias("r"))
    return left.join(right, ["node", "salt"]).where("not few or lb <= block").select("l", "r")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each list of the left has in common with each of the right."""
    flat = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*flat)
    hits = []
    for lists, x in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0))
        hit = np.zeros((len(lists), len(both)), np.float32)
        if len(both):
            known = both[at] == x
            hit[np.repeat(np.arange(len(lists)), [len(y) for y in lists])[known], at[known]] = 1
        hits.append(hit)
    return (hits[0] @ hits[1].T).astype(np.int64)


def _near_in_blocks(l, r, percent: int):
    """Ids (a from l, b from r) of different components that may reach the similarity.

    Each side has its set's lowest hashes. Up to the smaller of two last hashes both sides are known in
    full, a sample of the union; four standard errors are allowed for, or one hash where both sets are whole (upper halves can meet).
    """
    low = [[np.frombuffer(x.as_buffer(), np.uint32) for x in side.field("low")] for side in (l, r)]
    n, ids, component = ([_ints(side.field(f)) for side in (l, r)] for f in ("n", "id", "component"))
    whole = [np.array([len(x) == k for x, k in zip(xs, ks, strict=True)], bool) for xs, ks in zip(low, n, strict=True)]
    ends = [np.array([np.iinfo(np.uint32).max if w else x[-1] for x, w in zip(xs, ws, strict=True)], np.uint32) for xs, ws in zip(low, whole, strict=True)]
    both = _shared(*low)
    in_l = np.stack([np.searchsorted(x, np.minimum(ends[1], ends[0][i]), "right") for i, x in enumerate(low[0])])
    in_r = np.stack([np.searchsorted(x, np.minimum(ends[0], ends[1][j]), "right") for j, x in enumerate(low[1])]).T
    union = in_l + in_r - both
    estimate = both / union
    spare = np.where(whole[0][:, None] & whole[1][None, :], 1.5 / union, 4 * spread(percent) / np.sqrt(union))
    a, b = n[0][:, None], n[1][None, :]
    i, j = np.nonzero((component[0][:, None] != component[1][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (estimate >= percent / 100 - spare))
    return ids[0][i], ids[1][j]


def _block_pairs(met: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = _near_in_blocks(batch.column("l")[k].values, batch.column("r")[k].values, percent)
                yield out_batch(_PAIRS, np.minimum(a, b), np.maximum(a, b))

    return map_arrow(met, run, "a long, b long")


def _marked(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows: node, id, size. Rows of nodes that are not in one component, with their component, the node's
    largest one (top) and how many documents that has (k)."""
    marked = written(rows.join(edges.toDF("id", "component"), "id", "left").select("node", "size", "id", F.coalesce("component", "id").alias("component")), "marked")
    top = marked.groupBy("node", "size", "component").agg(F.count("*").alias("k")).groupBy("node", "size").agg(F.max(F.struct("k", "component")).alias("top"))
    salts = F.expr(f"1 + size div {SALT_ROWS}").cast("long")
    spread_ = top.select("node", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "top.*").toDF("node", "salt", "k", "top")
    return marked.withColumn("salt", F.pmod(F.xxhash64("id"), salts)).join(spread_, ["node", "salt"]).drop("salt").where("k < size")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough, as edges (u, v)."""
    one = lambda k: sets.select(F.col("id").alias(k), F.col("items").alias(f"s{k}"))
    rows = pairs.distinct().join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield out_batch(pa.schema([("u", pa.int64()), ("v", pa.int64())]), _ints(batch.column("a"))[keep], _ints(batch.column("b"))[keep])

    return map_arrow(rows, run, "u long, v long")


def _with_counts(rows: DataFrame) -> DataFrame:
    """node, id, size, pivot of the nodes with more than one document."""
    of = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", "node"), "id")).alias("p")).where("size > 1").select("node", "size", F.col("p.id").alias("pivot"))
    return rows.join(of, "node")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, items, low): the whole sets of some documents, read from their texts again, and their lowest hashes."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("items", pa.binary()), ("low", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            s = [shingle_set(t, words) for t in bytes_of(batch)]
            yield out_batch(schema, batch.column("doc_id"), [len(x) for x in s], [x.tobytes() for x in s], [lowest(x).tobytes() for x in s])

    return map_arrow(docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), run, "id long, n long, items binary, low binary")


def links(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed edges (u, v) between representatives, enough to give the components of all links."""
    spark = docs.sparkSession
    live = written(_with_counts(_first_nodes(reps, percent)), "nodes")
    sketches = written(reps.join(live.select("id").distinct(), "id", "left_semi"), "sketches")
    small, big = live.where(F.col("size") <= SMALL), live.where(F.col("size") > SMALL)
    pairs = written(_small_pairs(small, sketches, percent).distinct(), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(big.select("id")).distinct()
    sets = written(_full_sets(docs, named, words), "sets")
    edges = written(_confirmed(pairs, sets, percent), "edges")
    for depth in range(DEPTH, MOST_DEPTH + 1):
        if big.isEmpty():
            break
        edges = components(edges.union(_confirmed(_star_pairs(big, sketches, percent), sets, percent))).toDF("u", "v")
        ends = F.lit(True) if depth == MOST_DEPTH else (F.col("size") - F.col("k")) * F.col("size") <= WORK
        marked = _marked(big, edges).withColumn("ends", ends)
        found = _block_pairs(_blocks(marked.where("ends"), sets), percent)
        if depth < MOST_DEPTH:
            live = written(_with_counts(_children(marked.where("not ends").join(sketches, "id"), percent)), "nodes")
            found = found.union(_small_pairs(live.where(F.col("size") <= SMALL), sketches, percent))
            big = live.where(F.col("size") > SMALL)
        edges = written(edges.union(_confirmed(found, sets, percent)), "edges")
        if depth == MOST_DEPTH:
            big = spark.createDataFrame([], big.schema)
    return edges


def _judged(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """rows: doc_id, text, row (a hash of the text). Per row doc_id, row, n_shingles, component_id, kept, as a table."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            s = [shingle_set(t, words) for t in bytes_of(batch)]
            yield out_batch(schema, batch.column("doc_id"), batch.column("row"), [len(x) for x in s], [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in s], [sketch(x).tobytes() if len(x) else None for x in s])

    with scratch(rows.sparkSession):
        sets = written(map_arrow(rows, run, "doc_id long, row long, n long, digest binary, sketch binary"), "sets")
        classes = written(sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "classes")
        parts = components(links(rows, classes.select("id", "n", "sketch"), words, percent))
        of = classes.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
        out = sets.select("doc_id", "row", "n", "digest").join(of, "digest", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return written(out.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "neardup", keep=True)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id linked with it), kept.

    Documents are linked when 100 * intersection >= percent * union of their sets. Texts with the same
    set are one class, found by its digest; only its smallest doc_id takes part in the join. A text
    with fewer words than a shingle is one shingle; without words, or null, it has none and is linked
    with nothing. A text of any length gives its whole set. Each row is judged by its own text: rows that
    repeat have equal results, rows that share a doc_id and differ in text may be in different components.
    A null doc_id gets a null component and is kept; its row links nothing. Other columns are not looked
    at; an empty table gives an empty result. The result is a table in the shared folder.
    """
    rows = id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    return _judged(rows, words, percent).drop("row")


def select_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that near_duplicates() keeps, with all their columns: one of each component.

    Rows that repeat both doc_id and text are one document, of which one row stays, chosen by a hash of
    its other columns. Rows without a doc_id all stay.
    """
    found = _judged(id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text")), words, percent)
    a, b, k = (free_name(docs, x) for x in ("_id", "_row", "_k"))
    rows = docs.withColumns({a: F.col(id_col).cast("long"), b: F.xxhash64(F.col(text_col).cast("string"))})
    gone = found.where("not kept").select(F.col("doc_id").alias(a), F.col("row").alias(b)).distinct()
    left = rows.where(F.col(a).isNotNull()).join(gone, [a, b], "left_anti")
    one = left.withColumn(k, F.row_number().over(Window.partitionBy(a, b).orderBy(F.xxhash64(*map(_column, docs.columns))))).where(F.col(k) == 1)
    return one.select(*map(_column, docs.columns)).union(docs.where(F.col(id_col).cast("long").isNull()))


def _column(name: str):
    return F.col(f"`{name}`")
