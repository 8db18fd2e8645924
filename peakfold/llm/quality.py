"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds between grades.

The chance of at most grade k is sigmoid(threshold[k] - score). From it come the expected grade and the
chance of a grade that is good enough, by which texts are selected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import id_text, is_held_out, scratch
from peakfold.llm.features import Adam, CharVector, Rows, bounded, gather_rows, sample_texts, score_rows, select_rows, sigmoid

#: Bounds of the training sample: rows of a grade, rows in all; classes that grades are put into.
PER_GRADE, MOST_ROWS, MOST_GRADES = 1000, 4000, 20


def normalised(rows: Rows) -> Rows:
    """Rows of unit length."""
    size = np.sqrt(np.bincount(rows.of, rows.value.astype(np.float64) ** 2, rows.size))
    rows.value = (rows.value / np.maximum(size, 1e-9)[rows.of]).astype(np.float32)
    return rows


def train(rows: Rows, grades: np.ndarray, k: int, weights: np.ndarray, steps: int = 240, rate: float = 0.3, decay: float = 1e-5, part: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, k - 1 ordered thresholds) by minibatch descent; weights: of each grade's rows."""
    rng = np.random.default_rng(seed)
    share = np.array([weights[j] * (grades == j).sum() for j in range(k)])
    below = np.clip(np.cumsum(share)[:-1] / share.sum(), 0.01, 0.99)
    cut = np.log(below / (1 - below))
    first, gaps = cut[0], np.log(np.maximum(np.diff(cut), 0.05))
    w, adam, adam_t = np.zeros(rows.width), Adam(rows.width, rate), Adam(k - 1, 0.05)
    for _ in range(steps):
        pick = np.zeros(rows.size, bool)
        pick[rng.permutation(rows.size)[:part]] = True
        x, y = rows.take(pick), grades[pick]
        s, sure = x.dot(w), weights[y] / weights[grades].mean() / len(y)
        t = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), [np.inf]])
        high, low = sigmoid(np.clip(t[y + 1] - s, -500, 500)), sigmoid(np.clip(t[y] - s, -500, 500))
        p = np.maximum(high - low, 1e-9)
        w -= adam.step(x.back(sure * (1 - high - low)) + decay * w)
        to = np.zeros(k + 1)
        np.add.at(to, y + 1, -sure * high * (1 - high) / p)
        np.add.at(to, y, sure * low * (1 - low) / p)
        to = to[1:-1]
        step = adam_t.step(np.concatenate([[to.sum()], np.array([to[j + 1 :].sum() for j in range(k - 2)]) * np.exp(gaps)]))
        first -= step[0]
        gaps -= step[1:]
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def grade_classes(learn: DataFrame, most: int = MOST_GRADES):
    """(class of a grade as a column, value of each class in order, rows of each).

    Up to ``most`` different grades are a class each. More are put in order into ``most`` ranges with
    about equally many rows each, whose value is their mean grade; none is left out.
    """
    seen = [r[0] for r in learn.select("grade").distinct().limit(most + 1).collect()]
    cuts = sorted(seen)[1:] if len(seen) <= most else sorted(set(learn.agg(F.percentile_approx("grade", [k / most for k in range(1, most)], 10_000)).first()[0]))
    of = sum(((F.col("grade") >= c).cast("int") for c in cuts), F.lit(0))
    rows = learn.groupBy(of.alias("k")).agg(F.avg("grade").alias("value"), F.count("*").alias("n")).orderBy("k").collect()
    return of, {r.k: (r.value, r.n) for r in rows}


def fit(docs: DataFrame, ratings: DataFrame, vector: CharVector, modulus: int, remainder: int, per: int = PER_GRADE, total: int = MOST_ROWS):
    """(values of the grades in order, weights, thresholds) from rows outside the held-out fold."""
    learn = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("double").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & ~F.isnan("grade") & ~is_held_out("doc_id", modulus, remainder))
    of, classes = grade_classes(learn)
    if len(classes) < 2:
        return [v for v, _ in classes.values()], None, None
    with scratch(docs.sparkSession):
        keys = bounded(learn.select("doc_id", of.alias("grade")), "grade", per, total)
        rows, grades = gather_rows(sample_texts(docs, keys, ["grade"]), vector, ["grade"])
    names = sorted({g[0] for g in grades})
    if len(names) < 2:
        return [classes[k][0] for k in names], None, None
    y = np.searchsorted(names, [g[0] for g in grades])
    weights = np.array([classes[k][1] / (y == j).sum() for j, k in enumerate(names)])
    return [classes[k][0] for k in names], *train(normalised(rows), y, len(names), weights)


def _scorer(docs: DataFrame, ratings: DataFrame, vector: CharVector, good: float | None, least: float, modulus: int, remainder: int):
    """(values of the grades, scores of sparse rows: expected grades, chances of a good one, whether kept), the latter None without two grades."""
    values, w, cuts = fit(docs, ratings, vector, modulus, remainder)
    if w is None:
        return values, None
    grades = np.array(values)
    at = int(np.searchsorted(grades, grades[1] if good is None else good))

    def scores(rows):
        above = sigmoid(normalised(rows).dot(w)[:, None] - cuts[None, :])
        tail = np.ones(rows.size) if at == 0 else np.zeros(rows.size) if at > len(cuts) else above[:, at - 1]
        return grades[0] + above @ np.diff(grades), tail, tail >= least

    return values, scores


def score_quality(docs: DataFrame, ratings: DataFrame, good: float | None = None, least: float = 0.5, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_grade, tail_prob (of a grade of at least ``good``), kept (tail_prob >= least).

    ratings has doc_id and grade, any ordered numbers; good is by default the second lowest. With fewer
    than two grades there is nothing to learn: the one grade, or null, is expected, and all are kept.
    A row without text is scored as an empty one, a text of any length whole; repeated rows have equal
    scores, null keys go through; other columns are not looked at; an empty table gives no rows. Of ties
    in the sample's order, which is by the key's hash, the smaller key comes first; of several texts with
    one key the least is learned from. Null ratings and those that are no number don't count.
    """
    docs = id_text(docs, id_col, text_col)
    vector = CharVector((1, 2, 3), 15)
    values, scores = _scorer(docs, ratings, vector, good, least, modulus, remainder)
    if scores is None:
        return docs.select("doc_id", F.lit(values[0] if values else None).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail_prob"), F.lit(True).alias("kept"))
    return score_rows(docs, vector, lambda rows, batch: scores(rows), {"expected_grade": "double", "tail_prob": "double", "kept": "boolean"})


def select_good(docs: DataFrame, ratings: DataFrame, good: float | None = None, least: float = 0.5, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score_quality() keeps, with all their columns, each judged by its own text."""
    vector = CharVector((1, 2, 3), 15)
    _, scores = _scorer(id_text(docs, id_col, text_col), ratings, vector, good, least, modulus, remainder)
    return docs if scores is None else select_rows(docs, vector, lambda rows: scores(rows)[2], text_col)
