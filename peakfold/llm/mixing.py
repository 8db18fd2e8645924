"""Mixing sources to target weights: weighted sampling without replacement, cut at word budgets.

Each row draws an exponential key scaled by its quality weight; within a source rows stand in order of
their keys, and sizes are summed along that order up to the source's budget. A budget above the source's
size takes complete epochs first, and the rest of it from the order.

No source is sorted in one task. Keys fall into ranges of their logarithm, each with a small part of a
source whatever the weights are; sums by range give every range's offset, and only rows of one range
stand in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import ordered, scratch, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; the part of all sizes to share; most copies of a source.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
SEED = 2024
#: Ranges of keys in each doubling: the densest range has about 1 / 350 of a source.
RANGES = 128


def sizes(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: str = "text") -> Column:
    """A quality weight from the text alone: runs of letters for each word, from 0.1 to 1. Texts of marks,
    numbers and cut-up words weigh little."""
    share = F.try_divide(F.regexp_count(F.col(text), F.lit(r"\p{L}+")), F.regexp_count(F.col(text), F.lit(WORD)))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.1), share)), F.lit(0.1))


def uniform(seed: int, *cols: Column) -> Column:
    """A number between 0 and 1, neither included, that depends on the columns alone: 52 bits of their digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def budgets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """sources: source_key, source_size. Adds target: ``total`` of all sizes by weight, where no source has
    over ``most`` times its size and the excess goes to the others by weight.

    Sources stand in order of how soon their cap binds; a source is capped while its cap is below what the
    rest, shared by the weights that are left, would give it. Both orders are distributed.
    """
    placed = ordered(sources, ["source_key"], {}).withColumn("weight", F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")].cast("double"))
    caps = placed.withColumns({"cap": (F.col("source_size") * most).cast("double"), "bound": F.col("source_size") * most / F.col("weight")}).drop("place")
    lined = ordered(caps, ["bound", "source_key"], {"cap_before": "cap", "weight_before": "weight"})
    whole = caps.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    level = F.try_divide(F.lit(total * (whole["all"] or 0)) - F.col("cap_before"), F.lit(whole["w"] or 0.0) - F.col("weight_before"))
    open_ = lined.withColumn("level", level).where(F.col("bound") > F.col("level"))
    last = open_.agg(F.min_by("level", F.struct("bound", "source_key"))).first()[0]
    target = F.col("cap") if last is None else F.when(F.col("bound") > last, F.col("weight") * F.lit(last)).otherwise(F.col("cap"))
    return caps.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = SEED, weights=WEIGHTS, total: float = TOTAL, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and epochs, the complete copies of its source.

    A source's budget is its target; the row at which it ends is taken if that brings the source nearer to
    it, so a source misses its target by half a row at most. A row is taken whole, once more than its
    source's epochs at most. Rows of a size of 0, such as null and empty texts, take nothing; a weight that
    is null or not above 0 counts as the least there is, so such rows come last. A null source is one of its
    own, after the others. Keys come from seed, doc_id and text: repeated rows have equal keys and stand
    together, of those at a budget's end some are taken; null keys are rows like others. Long texts count
    whole; an empty table gives no rows; other columns are not looked at.
    """
    size = sizes(text_col) if size is None else size
    weight = plain_share(text_col) if weight is None else weight
    key = -F.ln(uniform(seed, F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))) / F.greatest(F.coalesce(weight.cast("double"), F.lit(1e-9)), F.lit(1e-9))
    named = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    columns = [F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), named.alias("source_key"), key.alias("key")]
    with scratch(docs.sparkSession):
        rows = written(docs.select(*columns).withColumn("range", F.floor(F.log2("key") * RANGES).cast("int")), "mix-rows", keep=True)
        ranges = written(rows.groupBy("source_key", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
        plan = written(budgets(ranges.groupBy("source_key").agg(F.sum("range_size").alias("source_size")), weights, total, most), "mix-plan")
        before = F.sum("range_size").over(Window.partitionBy("source_key").orderBy("range")) - F.col("range_size")
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        offsets = ranges.withColumn("before", before).drop("range_size").join(plan, "source_key").withColumn("epochs", epochs)
        offsets = written(offsets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-offsets", keep=True)
    line = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("before") + F.sum("size").over(line)  # with the row itself
    fits = (2 * done - F.col("size")) <= 2 * F.col("rest")
    taken = F.col("size") * (F.col("epochs") + fits.cast("long"))
    return rows.join(offsets, ["source_key", "range"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "epochs")
