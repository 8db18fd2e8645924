"""Duplicate scan: a self-join of the index on shared hashes at a constant time offset."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.config import Scan
from peakfold.functions.numbers import rounded
from peakfold.session import ship_package, written


def per_hash(index: DataFrame, p: Scan = Scan()) -> DataFrame:
    """(hash, spread) of hashes that aren't too common, which bounds what one hash can add to the self-join;
    spread tells whether two resources have it, as others can't make a pair."""
    each = index.groupBy("hash").agg(F.count("*").alias("n"), F.min("resource_id").alias("lo"), F.max("resource_id").alias("hi"))
    return each.where(F.col("n") <= p.max_per_hash).select("hash", (F.col("lo") < F.col("hi")).alias("spread"))


def eligible(index: DataFrame, p: Scan = Scan()) -> DataFrame:
    return per_hash(index, p).select("hash")


def eligible_rows(index: DataFrame, p: Scan = Scan()) -> DataFrame:
    """Rows of the index with eligible hashes, and spread. An index whose rows tell both (n, spread) is read once."""
    if {"n", "spread"} <= set(index.columns):
        return index.where(F.col("n") <= p.max_per_hash).drop("n")
    return index.join(per_hash(index, p), "hash")


def shared(index: DataFrame, catalog: DataFrame, p: Scan = Scan(), rows: DataFrame | None = None) -> DataFrame:
    """Eligible rows that two resources have at least, with the catalog's durations."""
    meta = catalog.where("duration > 0").select("resource_id", "duration")
    return (eligible_rows(index, p) if rows is None else rows).where("spread").drop("spread").join(meta, "resource_id")


def second(t: str, p: Scan = Scan()):
    return F.floor(F.col(t) / p.frames_per_second).cast("long")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = lambda k: rows.select("hash", F.col("resource_id").alias(k), F.col("t1").alias(f"t{k}"), F.col("duration").alias(f"d{k}"))
    return one("a"), one("b")


#: Rows of one or more hashes that meet at a time, and pairs that are given on at a time; rows that a task is to have.
MEET, GIVE, TASK_ROWS = 50_000, 500_000, 500_000


def tasks_of(rows: DataFrame) -> int:
    """How many tasks are to meet the rows of a table; they follow its rows, as these make many more pairs than an exchange can tell."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)


def raw_pairs(rows: DataFrame, p: Scan = Scan(), new: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Rows of a hash's pairs of resources at every offset that counts: a, b, bucket, and the second of each side.

    rows: hash, resource_id, t1, duration. new: resource_id; then pairs of which one resource at least is new.
    A hash's rows come in order of time, so each meets those after it as far as the offset goes, all hashes of a piece at once.
    Rows that tell the least resource of their hash (lo) are dealt out by it: copies share most of their hashes, so these go
    to one task and a pair's hits are mostly counted there. A resource has a bounded number of hashes and these of rows.
    """
    far, shift, width, rate, apart = p.max_offset_frames, p.shift, p.bucket, p.frames_per_second, p.max_duration_difference

    def meet(h, key, t, d, fresh):
        left, k = np.arange(len(h)), 1
        if len(h):
            begins = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            left = left[np.repeat(np.logical_or.reduceat(fresh, begins), np.diff(np.append(begins, len(h))))]
        while (left := left[left + k < len(h)]).size:
            left = left[(h[left + k] == h[left]) & (t[left + k] - t[left] <= far)]
            one = left[(key[left] != key[left + k]) & (np.abs(d[left + k] - d[left]) <= apart) & (fresh[left] | fresh[left + k])]
            swap = key[one] > key[one + k]
            yield np.where(swap, one + k, one), np.where(swap, one, one + k)
            k += 1

    def given(key, t, found) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        second = lambda x: np.floor(t[x] / rate).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[a], key[b], (t[b] - t[a] + shift) // width, second(a), second(b))], names=["a", "b", "bucket", "sa", "sb"])

    def pairs(cols):
        found, n = [], 0
        for x in meet(*cols):
            found.append(x)
            n += len(x[0])
            if n >= GIVE:
                yield given(cols[1], cols[2], found)
                found, n = [], 0
        if n:
            yield given(cols[1], cols[2], found)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= MEET:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = n - np.argmin(np.append(cols[0][::-1] == cols[0][-1], False))  # the last hash may go on
                yield from pairs([c[:cut] for c in cols])
                held, n = [[c[cut:] for c in cols]], n - cut
        if n:
            yield from pairs([np.concatenate(c) for c in zip(*held, strict=True)])

    ship_package(rows.sparkSession)
    if new is None:
        marked = rows.withColumn("fresh", F.lit(True))
    else:
        marked = rows.join(new.select("resource_id").distinct().withColumn("fresh", F.lit(True)), "resource_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    by = ["lo"] if "lo" in rows.columns else ["hash"]
    dealt = marked.repartition(tasks, *by) if tasks else marked.repartition(*by)
    columns = [F.col("hash").cast("long"), F.col("resource_id").cast("long"), F.col("t1").cast("long"), F.col("duration").cast("double"), F.col("fresh")]
    return dealt.sortWithinPartitions(*by, "hash", "t1").select(*columns).mapInArrow(run, "a long, b long, bucket long, sa long, sb long")


def hit_counts(raw: DataFrame) -> DataFrame:
    """(a, b, bucket, hits); a count is all the state that a pair's bucket has while raw pairs are made."""
    return raw.groupBy("a", "b", "bucket").agg(F.count("*").alias("hits"))


def at_peak(counts: DataFrame, least_hits: int) -> DataFrame:
    """(a, b, peak, bucket, hits): of buckets with enough hits each pair's strongest one and its neighbours; of equals the lowest."""
    strongest = F.first("bucket").over(Window.partitionBy("a", "b").orderBy(F.desc("hits"), "bucket"))
    near = counts.where(F.col("hits") >= least_hits).withColumn("peak", strongest)
    return near.where(F.abs(F.col("bucket") - F.col("peak")) <= 1).select("a", "b", "peak", "bucket", "hits")


def worth_it(near: DataFrame, track: DataFrame, least: float) -> DataFrame:
    """The rows of pairs that can be similar enough: no more seconds can be covered than there are aligned hits."""
    hits = near.groupBy("a", "b").agg(F.sum("hits").alias("n"))
    size = lambda k: track.where("eligible_seconds > 0").select(F.col("resource_id").alias(k), F.col("eligible_seconds").alias(f"e{k}"))
    able = hits.join(size("a"), "a").join(size("b"), "b").where(F.col("n") + 1e-6 >= least * F.greatest("ea", "eb"))
    return near.join(able.select("a", "b"), ["a", "b"], "left_semi")


def _bits(df: DataFrame, keys: list[str], second: str) -> DataFrame:
    """Bitmaps of seconds: a row of a fixed size for each key and 32,768 seconds (number)."""
    at = F.col(second) + 1
    return df.groupBy(*keys, F.bitmap_bucket_number(at).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def pair_seconds(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, bucket, side, number, bits) of the wanted (a, b, bucket)."""
    rows = raw.join(wanted.select("a", "b", "bucket"), ["a", "b", "bucket"])
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("sa").alias("second")), F.struct(F.lit("b").alias("side"), F.col("sb").alias("second")))
    return _bits(rows.select("a", "b", "bucket", F.explode(sides).alias("x")).select("a", "b", "bucket", "x.*"), ["a", "b", "bucket", "side"], "second")


def track_seconds(rows: DataFrame, p: Scan = Scan()) -> DataFrame:
    """(resource_id, number, bits): the seconds that have an eligible row. Rows are dealt out by resource first, so that a
    task has the bitmaps of its own resources alone and not of all that its part of the index names."""
    return _bits(rows.select("resource_id", second("t1", p).alias("second")).repartition("resource_id"), ["resource_id"], "second")


def counted(bits: DataFrame, *keys: str) -> DataFrame:
    return bits.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("eligible_seconds"))


def tracks(index: DataFrame, p: Scan = Scan(), seconds: DataFrame | None = None) -> DataFrame:
    """(resource_id, fingerprints, eligible_seconds): how many rows, and how many seconds that have an eligible one."""
    seconds = track_seconds(eligible_rows(index, p), p) if seconds is None else seconds
    all_ = index.groupBy("resource_id").agg(F.count("*").alias("fingerprints"))
    return all_.join(counted(seconds, "resource_id"), "resource_id", "left").select("resource_id", "fingerprints", F.coalesce("eligible_seconds", F.lit(0).cast("long")).alias("eligible_seconds"))


def buckets(index: DataFrame, catalog: DataFrame, p: Scan = Scan(), rows: DataFrame | None = None) -> DataFrame:
    """(a, b, bucket, hits, seconds_a, seconds_b): buckets of pairs with enough hits, and how many seconds of each side have one."""
    rows = written(shared(index, catalog, p, rows), "shared")
    raw = raw_pairs(rows, p, tasks=tasks_of(rows))
    counts = written(hit_counts(raw).where(F.col("hits") >= p.min_bucket_hits), "counts")
    size = pair_seconds(raw, counts).groupBy("a", "b", "bucket", "side").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    both = size.groupBy("a", "b", "bucket").agg(F.max(F.when(F.col("side") == "a", F.col("n"))).alias("seconds_a"), F.max(F.when(F.col("side") == "b", F.col("n"))).alias("seconds_b"))
    return counts.join(both, ["a", "b", "bucket"])


def score_pairs(near: DataFrame, seconds: DataFrame, track: DataFrame, p: Scan = Scan(), least: float | None = None) -> DataFrame:
    """Pairs with the coverage of each side. near: at_peak()'s rows; seconds: pair_seconds() of these buckets; track: track_seconds().

    Bitmaps of a pair's buckets are united; of these seconds those count that the track has as eligible.
    """
    sums = near.groupBy("a", "b", "peak").agg(F.sum("hits").alias("aligned_hits"))
    united = seconds.groupBy("a", "b", "side", "number").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("resource_id", F.when(F.col("side") == "a", F.col("a")).otherwise(F.col("b")))
    two = united.join(track.withColumnRenamed("bits", "own"), ["resource_id", "number"]).select("a", "b", "side", "number", F.explode(F.array("bits", "own")).alias("bits"))
    common = two.groupBy("a", "b", "side", "number").agg(F.bitmap_and_agg("bits").alias("bits"))
    n = F.bitmap_count("bits")
    seen = common.groupBy("a", "b").agg(F.sum(F.when(F.col("side") == "a", n)).alias("ca"), F.sum(F.when(F.col("side") == "b", n)).alias("cb"))
    whole = lambda k: counted(track, "resource_id").select(F.col("resource_id").alias(k), F.col("eligible_seconds").alias(f"e{k}"))
    cover = lambda k: F.coalesce(f"c{k}", F.lit(0)) / F.col(f"e{k}")
    offset = (F.col("peak") * p.bucket - p.shift + p.bucket / 2) / p.frames_per_second
    rows = sums.join(seen, ["a", "b"]).join(whole("a").where("ea > 0"), "a").join(whole("b").where("eb > 0"), "b")
    out = rows.select("a", "b", offset.alias("offset_seconds"), "aligned_hits", cover("a").alias("coverage_a"), cover("b").alias("coverage_b"))
    return out.where(F.least("coverage_a", "coverage_b") >= (p.min_similarity if least is None else least))


def scored(rows: DataFrame, counts: DataFrame, seconds: DataFrame, p: Scan, least: float | None = None, new: DataFrame | None = None) -> DataFrame:
    """From counts of hits to pairs. rows: what raw pairs are made from; only those of pairs that can be similar
    enough are met again, for their seconds."""
    near = written(at_peak(counts, p.min_bucket_hits), "peaks")
    near = written(worth_it(near, counted(seconds, "resource_id"), p.min_similarity if least is None else least), "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("resource_id")).distinct()
    again = raw_pairs(rows.join(ids, "resource_id", "left_semi"), p, new)
    return score_pairs(near, pair_seconds(again, near), seconds, p, least)


def scan(index: DataFrame, catalog: DataFrame, p: Scan = Scan(), new: DataFrame | None = None) -> DataFrame:
    """All pairs of similar resources, or those with a new one (new: resource_id). What is read more than once is a table;
    eligible rows are one only where a join finds them."""
    rows = eligible_rows(index, p)
    rows = rows if {"n", "spread"} <= set(index.columns) else written(rows, "eligible")
    met = written(shared(index, catalog, p, rows), "shared")
    seconds = written(track_seconds(rows, p), "seconds")
    return scored(met, hit_counts(raw_pairs(met, p, new, tasks_of(met))), seconds, p, new=new)


def updated(pairs: DataFrame, fresh: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of an earlier scan with those of a scan of new resources; an earlier pair that has a new resource gives way."""
    ids = new.select("resource_id")
    old = pairs.join(ids.toDF("a"), "a", "left_anti").join(ids.toDF("b"), "b", "left_anti")
    return old.unionByName(fresh)


def verify(index: DataFrame, asked: DataFrame, p: Scan = Scan()) -> DataFrame:
    """asked: keep, other. Their pairs as a scan scores them, from current rows and without a limit on durations.

    Only the asked resources' rows take part; a hash is eligible by its rows in the whole index. A pair
    without any aligned hit is missing.
    """
    wanted = asked.select("keep", "other").where("keep <> other").distinct()
    ids = wanted.select(F.col("keep").alias("resource_id")).union(wanted.select("other")).distinct()
    some = index.join(ids, "resource_id", "left_semi")
    common = index.join(some.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") <= p.max_per_hash).select("hash")
    rows = written(some.join(common, "hash", "left_semi").withColumn("duration", F.lit(0.0)), "verify")
    a, b = _sides(rows)
    pairs = wanted.select(F.least("keep", "other").alias("a"), F.greatest("keep", "other").alias("b")).distinct()
    met = a.join(pairs, "a").join(b, ["hash", "b"]).where(F.abs(F.col("tb") - F.col("ta")) <= p.max_offset_frames)
    raw = met.select("a", "b", F.expr(f"(tb - ta + {p.shift}) div {p.bucket}").alias("bucket"), second("ta", p).alias("sa"), second("tb", p).alias("sb"))
    near = written(at_peak(hit_counts(raw), 1), "verify")
    return score_pairs(near, pair_seconds(raw, near), track_seconds(rows, p), p, least=0.0)


def from_kept_side(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: keep, other. Each asked pair as seen from the kept resource; unknown pairs have no similarity."""
    one = lambda keep, other, sign: pairs.select(F.col(keep).alias("keep"), F.col(other).alias("other"), F.col(f"coverage_{keep}").alias("coverage_keep"), F.col(f"coverage_{other}").alias("coverage_other"), (sign * F.col("offset_seconds")).alias("offset_seconds"), "aligned_hits")
    both = one("a", "b", 1).unionByName(one("b", "a", -1))
    return asked.select("keep", "other").distinct().join(both, ["keep", "other"], "left").withColumn("similarity", F.coalesce(F.least("coverage_keep", "coverage_other"), F.lit(0.0)))


def decided(seen: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds to each pair of a kept resource whether it is verified, and whether the request may delete: only if all are."""
    rows = seen.withColumn("verified", F.col("similarity") >= least)
    return rows.withColumn("allowed", F.min("verified").over(Window.partitionBy("keep")))


def ranked_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, size, max_similarity) of all groups; by aggregates, so a group of any size is no array."""
    size = groups.groupBy("component").agg(F.count("*").alias("size"))
    best = pairs.select("a", similarity().alias("similarity")).join(groups.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.max("similarity").alias("max_similarity"))
    return size.join(best, "component")


def _strongest() -> list:
    """Strongest groups first, then larger ones, then by their first member."""
    return [F.desc("max_similarity"), F.desc("size"), F.asc("component")]


def pairs_in_order(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, a, b, similarity, place): each group's pairs by similarity, then ids."""
    rows = pairs.select("a", "b", similarity().alias("similarity")).join(groups.withColumnRenamed("id", "a"), "a")
    w = Window.partitionBy("component").orderBy(F.desc("similarity"), "a", "b")
    return rows.select("component", "a", "b", "similarity", F.row_number().over(w).cast("long").alias("place"))


def listing(pairs: DataFrame, groups: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(component, size, max_similarity, members, pairs): a page of groups, or all, in order, each with its ids and
    its pairs in order. Only groups of the page are gathered."""
    shown = ranked_groups(pairs, groups)
    if limit is not None:
        shown = shown.orderBy(*_strongest()).offset(offset).limit(limit)
        groups = groups.join(shown.select("component"), "component", "left_semi")
    members = groups.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    listed = pairs_in_order(pairs, groups).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "similarity"))).alias("p"))
    rows = shown.join(members, "component").join(listed, "component")
    return rows.select("component", "size", "max_similarity", "members", F.transform("p", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["similarity"].alias("similarity"))).alias("pairs")).orderBy(*_strongest())


def similarity():
    return F.least("coverage_a", "coverage_b")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, other, similarity), each pair from both sides."""
    s = pairs.select("a", "b", similarity().alias("similarity"))
    return s.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").union(s.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))


def exact_sum(x: str):
    """The sum of fractions from 0 to 1 as the nearest double, whatever their order: they are added as whole numbers of 2^-53,
    which a double of a half or more is. A sum of doubles depends on how rows arrive, and with it what it rounds to."""
    return F.sum((F.col(x) * float(1 << 53)).cast("decimal(17,0)")).cast("double") / float(1 << 53)


def member_similarity(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: id, component. Per member the largest, least and mean similarity; a pair that is missing counts 0 in the mean."""
    size = groups.groupBy("component").agg(F.count("*").alias("size"))
    s = both_ways(pairs).groupBy("id").agg(F.max("similarity").alias("max_similarity"), F.min("similarity").alias("min_similarity"), exact_sum("similarity").alias("total"))
    return groups.join(size, "component").join(s, "id").select("id", "component", "size", "max_similarity", "min_similarity", (F.col("total") / (F.col("size") - 1)).alias("mean_similarity"))


def hundredths(x):
    return rounded(x, 2)


def density():
    return F.when(F.col("duration") > 0, hundredths(F.col("num_fingerprints") / F.col("duration"))).otherwise(F.lit(0.0))


def recommend(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """The member of each component to keep: mean similarity and density, both to two decimals, duration, then the smaller id. Deleted ones aren't in the catalog."""
    w = Window.partitionBy("component").orderBy(F.desc(hundredths(F.col("mean_similarity"))), F.desc("density"), F.desc("duration"), "id")
    c = catalog.select(F.col("resource_id").alias("id"), "duration", "num_fingerprints")
    return members.join(c, "id").withColumn("density", density()).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("component", F.col("id").alias("keep"))


#: Edges that a task joins into stars at a time before the first round.
CONTRACT = 200_000


def contracted(edges: DataFrame, at_once: int | None = None) -> DataFrame:
    """edges: u, v. Edges with the same components, as each task's runs of edges become a star for each component of theirs."""
    most = at_once or CONTRACT

    def stars(held: list) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            path = []
            while (up := root.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for p in path:
                root[p] = x
            return x

        for batch in held:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                root[high] = low
        out = [(x, t) for x in list(root) if (t := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                held.append(batch.slice(k, most))
                n += held[-1].num_rows
                if n >= most:
                    yield stars(held)
                    held, n = [], 0
        if held:
            yield stars(held)

    ship_package(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(pairs: DataFrame, most: int = 100) -> DataFrame:
    """(id, component): connected components, named by their smallest id.

    Edges become stars within tasks first; where one task has them all, that is the result. Else rounds of least
    labels of neighbours and of labels' labels follow, each written to the shared folder; the number of rounds is
    logarithmic in a component's diameter for the most part. Raises if ``most`` don't suffice.
    """
    ends = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    tasks = ends.count() // CONTRACT + 1
    stars = written(contracted(ends.coalesce(tasks)), "edges")
    if tasks == 1:
        return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
    edges = written(stars.union(stars.select("v", "u")).toDF("id", "other").distinct(), "edges")
    labels = edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component"))
    for _ in range(most):
        near = edges.join(labels.withColumnsRenamed({"id": "other", "component": "c"}), "other").groupBy("id").agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = written(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "old"), "labels")
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components are not found within {most} rounds")
