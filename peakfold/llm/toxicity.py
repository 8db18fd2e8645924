"""Toxicity by non-negative positive-unlabelled learning.

A linear model over words, their beginnings and inner n-grams. Its risk needs confirmed toxic texts and
unlabelled ones only: the negative part is the unlabelled risk less the class prior's share of the
positives'; where that falls below zero the step goes against it, which keeps the risk non-negative.
The prior is given, or the toxic share of labelled rows, or, where only toxic rows are labelled, estimated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import id_text, is_held_out, scratch
from peakfold.llm.features import Adam, Rows, WordVector, bounded, feature_counts, gather_rows, sample_texts, score_rows, select_rows, sigmoid

#: Bounds of the training sample: toxic texts, unlabelled texts.
POSITIVES, UNLABELLED = 1500, 4000
#: A feature counts if so many toxic texts have it and its log-likelihood ratio is at least this.
LEAST_TEXTS, LEAST_RATIO = 4, 18.0


def train(positive: Rows, unlabelled: Rows, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias with the least non-negative risk under logistic loss."""
    w, bias, adam = np.zeros(positive.width), float(np.log(prior / (1 - prior))), Adam(positive.width + 1, rate)
    for _ in range(steps):
        zp, zu = positive.dot(w) + bias, unlabelled.dot(w) + bias
        as_negative_p, as_negative_u = -prior * sigmoid(zp) / positive.size, sigmoid(zu) / unlabelled.size
        if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
            gp, gu = -prior * sigmoid(-zp) / positive.size + as_negative_p, as_negative_u
        else:
            gp, gu = -as_negative_p, -as_negative_u
        step = adam.step(np.append(positive.back(gp) + unlabelled.back(gu) + decay * w, gp.sum() + gu.sum()))
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def informative(positive: Rows, unlabelled: Rows) -> np.ndarray:
    """Features that toxic texts have more often than unlabelled ones, by a likelihood-ratio test."""
    np_, nu = positive.back(np.ones(positive.size)), unlabelled.back(np.ones(unlabelled.size))
    p, u = (np_ + 0.5) / (positive.size + 1), (nu + 0.5) / (unlabelled.size + 1)
    ratio = 2 * (np_ * np.log(p / u) + (positive.size - np_) * np.log((1 - p) / (1 - u)))
    return np.flatnonzero((p > 1.5 * u) & (ratio >= LEAST_RATIO) & (np_ >= LEAST_TEXTS))


def estimated_prior(positive: Rows, unlabelled: Rows, p_half: np.ndarray, u_half: np.ndarray) -> float:
    """The toxic share of unlabelled texts: how many score at least what half of the toxic ones do, times two.

    Each half of the texts is scored by a model of the other half. Where no feature tells them apart, the least.
    """
    shares = []
    for half in (0, 1):
        p, u = positive.take(p_half != half), unlabelled.take(u_half != half)
        held_p, held_u = positive.take(p_half == half), unlabelled.take(u_half == half)
        if not (p.size and u.size and held_p.size and held_u.size):
            continue
        at = informative(p, u)
        if not len(at):
            continue
        w, _ = train(p.only(at), u.only(at), 0.5)
        zp, zu = held_p.only(at).dot(w), held_u.only(at).dot(w)
        line = np.median(zp)
        shares.append((zu >= line).mean() / (zp >= line).mean())
    least = 1 / (unlabelled.size + 1)
    return float(np.clip(np.mean(shares) if shares else least, least, 0.9))


def worth_gathering(sample: DataFrame, vector: WordVector) -> np.ndarray:
    """Features that are informative over the sample's rows or over either half of them, found on executors.

    sample: kind (1: toxic, 0: unlabelled), half, text. Only these come to the driver.
    """
    counted = feature_counts(sample, vector, ["kind", "half"])
    sizes = {(r.kind, r.half): r.n for r in counted.where("at = -1").collect()}
    n = lambda kind, half: F.sum(F.when((F.col("kind") == kind) & (F.col("half") == half), F.col("n")).otherwise(0)).cast("double").alias(f"n{kind}{half}")
    rows = counted.where("at >= 0").groupBy("at").agg(*(n(kind, half) for kind in (0, 1) for half in (0, 1)))

    def test(halves):
        of = lambda kind: sum((F.col(f"n{kind}{h}") for h in halves), F.lit(0.0))
        size = [float(sum(sizes.get((kind, h), 0) for h in halves)) for kind in (0, 1)]
        p, u = (of(1) + 0.5) / (size[1] + 1), (of(0) + 0.5) / (size[0] + 1)
        ratio = 2 * (of(1) * F.log(p / u) + (size[1] - of(1)) * F.log((1 - p) / (1 - u)))
        return (p > 1.5 * u) & (ratio >= LEAST_RATIO - 1e-6) & (of(1) >= LEAST_TEXTS)

    return np.array(sorted(r.at for r in rows.where(test((0, 1)) | test((0,)) | test((1,))).select("at").collect()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, vector: WordVector, modulus: int = 5, remainder: int = 0, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """(indices, weights, bias), learned from rows outside the held-out fold."""
    none = np.empty(0, np.int64), np.empty(0), -30.0
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("y")).where(F.col("doc_id").isNotNull() & ~is_held_out("doc_id", modulus, remainder) & F.col("y").isNotNull())
    learn = learn.join(docs.select("doc_id"), "doc_id", "left_semi")  # the share of the rows that are there is their prior
    n, toxic = learn.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return none
    with scratch(docs.sparkSession):
        some = bounded(learn.where("y = 1").select("doc_id", F.lit(1).alias("kind")), "kind", positives, positives)
        rest = bounded(docs.select("doc_id", F.lit(0).alias("kind")).where(~is_held_out("doc_id", modulus, remainder)), "kind", unlabelled, unlabelled)
        keys = some.union(rest).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
        sample = sample_texts(docs, keys, ["kind", "half"])
        at = worth_gathering(sample, vector)
        rows, kinds = gather_rows(sample, vector.only(at), ["kind", "half"])
    is_positive = np.array([k[0] == 1 for k in kinds], bool)
    half = np.array([k[1] for k in kinds], np.int64)
    positive, other = rows.take(is_positive), rows.take(~is_positive)
    if not positive.size or not other.size or not len(at):
        return none if not positive.size or not other.size else (none[0], none[1], float(np.log(p / (1 - p))) if 0 < (p := prior or toxic / n) < 1 else -30.0)
    if prior is None:
        prior = toxic / n if toxic < n else estimated_prior(positive, other, half[is_positive], half[~is_positive])
    chosen = informative(positive, other)
    w, bias = train(positive.only(chosen), other.only(chosen), prior)
    return at[chosen], w, bias


def _scorer(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, prior: float | None):
    """(features, scores of sparse rows of them)."""
    vector = WordVector(inner=4)
    at, w, bias = fit(docs, labels, vector, modulus, remainder, prior)
    return vector.only(at), lambda rows: sigmoid(rows.dot(w) + bias) if len(w) else np.full(rows.size, float(sigmoid(bias)))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    prior, between 0 and 1, is the toxic share of all texts. Where it isn't given it is that of labelled
    rows among them, or, if all of these are toxic, estimated from the scores of unlabelled texts.

    A row without text, or without any known feature, gets the score of the bias. Where no row is
    labelled toxic the score is about 0. A text of any length is scored whole. Rows are scored on their
    text alone: repeated rows have equal scores, null keys (not held out) go through; other columns are
    not looked at; an empty table gives no rows. Of ties in the sample's order, which is by the key's
    hash, the smaller key comes first; of several texts with one key the least is learned from.
    """
    docs = id_text(docs, id_col, text_col)
    vector, score = _scorer(docs, labels, modulus, remainder, prior)
    out = score_rows(docs, vector, lambda rows, batch: (score(rows),), {"score": "double"})
    return out.select("doc_id", F.coalesce(is_held_out("doc_id", modulus, remainder), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def select_clean(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> DataFrame:
    """The rows that score_toxicity() doesn't predict to be toxic, with all their columns, each judged by its own text."""
    vector, score = _scorer(id_text(docs, id_col, text_col), labels, modulus, remainder, prior)
    return select_rows(docs, vector, lambda rows: score(rows) < 0.5, text_col)
