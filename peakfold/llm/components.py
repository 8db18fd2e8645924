"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import map_arrow, written

#: Edges that a task contracts at a time before the first step.
CONTRACT = 200_000


def _contract(batches, most: int = 2 * CONTRACT):
    """Replaces the edges of a run of rows by a star for each of their components."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def stars(pairs: list[np.ndarray]):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for part in pairs:
            for a, b in part.tolist():
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        out = [(x, find(x)) for x in list(root) if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(c)) for c in ("u", "v")], 1))
        n += batch.num_rows
        if n >= most:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges u > v; what it returns has the same components."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(low, "u")
    to = met.where("v > m" if small else "v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        to = to.union(low)
    return to.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids that edges (u, v) link with a smaller one; component is the smallest.

    Edges are first contracted within tasks of CONTRACT edges each; where one task has them all, that
    is the result. Else each round writes its edges to the shared folder, so lineage stays short; the
    number of rounds is logarithmic. No ids, links or labels reach the driver.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "cc")
    tasks = e.count() // CONTRACT + 1
    e = written(map_arrow(e.coalesce(tasks), _contract, "u long, v long"), "cc")
    mark = F.expr("bit_xor(xxhash64(u, v))")
    state = None
    while tasks > 1:
        now = tuple(e.agg(F.count("*"), mark).first())
        if now == state or not now[0]:
            break
        state = now
        e = written(_star(_star(e, False), True), "cc")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
