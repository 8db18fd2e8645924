"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Trained by follow-the-regularised-leader with an elastic net, which leaves most weights at zero; then
one temperature is fitted on rows kept back, so that scores are chances.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import id_text, is_held_out, scratch, texts_of
from peakfold.llm.features import CharVector, Rows, bounded, gather_rows, sample_texts, score_rows

#: Bounds of the training sample: rows of a language, rows in all, languages (the most frequent ones).
PER_LANGUAGE, MOST_ROWS, LANGUAGES = 500, 4000, 100
LETTER = regex.compile(r"\p{L}")


def weighted(rows: Rows, idf: np.ndarray) -> Rows:
    """Log counts times inverse document frequency, at unit length."""
    value = rows.value * idf[rows.at]
    size = np.sqrt(np.bincount(rows.of, value.astype(np.float64) ** 2, rows.size))
    rows.value = (value / np.maximum(size, 1e-9)[rows.of]).astype(np.float32)
    return rows


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


class Leader:
    """Follow the regularised leader, a rate for each coordinate, L1 and L2 penalties."""

    def __init__(self, width: int, k: int, rate: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.z, self.n = np.zeros((width, k)), np.zeros((width, k))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.rate + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = softmax(value @ w)
        g[y] -= 1
        g = value[:, None] * g[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least loss on these rows."""
    tries = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def scores_of(rows: Rows, w: np.ndarray) -> np.ndarray:
    return np.stack([rows.dot(w[:, j]) for j in range(w.shape[1])], axis=1)


def train(rows: Rows, y: np.ndarray, k: int, passes: int = 2, seed: int = 0):
    """(inverse document frequencies, weights, temperature)."""
    idf = np.log((1 + rows.size) / (1 + np.bincount(rows.at, minlength=rows.width))) + 1
    rows = weighted(rows, idf)
    order = np.random.default_rng(seed).permutation(rows.size)
    back, learn = order[: rows.size // 5], order[rows.size // 5 :]
    leader, ends = Leader(rows.width, k), np.cumsum(rows.lens)
    for _ in range(passes):
        for r in learn.tolist():
            part = slice(ends[r] - rows.lens[r], ends[r])
            leader.learn(rows.at[part], rows.value[part].astype(np.float64), int(y[r]))
    w = leader.weights()
    keep = np.zeros(rows.size, bool)
    keep[back if len(back) else learn] = True
    return idf, w, temperature(scores_of(rows.take(keep), w), y[keep])


def identify(docs: DataFrame, labelled: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text", per: int = PER_LANGUAGE, total: int = MOST_ROWS, languages: int = LANGUAGES) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the calibrated chance of lang_pred).

    labelled has doc_id and lang; rows of the held-out fold are not learned from. A text that is null or
    without any letter is "und" with score 0, as are all where no language is known. With one language
    known, it is predicted with score 1. A text of any length is read whole. Repeated rows have equal
    results, null keys (not held out, not learned from) go through; other columns are not looked at; an
    empty table gives no rows. Of languages with equal chances the first by name is predicted; of ties in
    the sample's order, which is by the key's hash, the smaller key comes first.
    """
    learn = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out("doc_id", modulus, remainder))
    docs = id_text(docs, id_col, text_col)
    vector = CharVector((1, 2, 3), 15, lower=True)
    with scratch(docs.sparkSession):
        keys = bounded(learn, "lang", per, total, languages)
        rows, langs = gather_rows(sample_texts(docs, keys, ["lang"]), vector, ["lang"])
    names, y = np.unique(np.array([x[0] for x in langs], object).astype(str), return_inverse=True) if langs else (np.empty(0, str), np.empty(0, int))
    names = names.tolist()
    idf, w, heat = train(rows, y, len(names)) if len(names) > 1 else (None, None, 1.0)

    def scores(rows, batch):
        written = np.array([bool(LETTER.search(t)) for t in texts_of(batch)], bool)
        if not names:
            return ["und"] * rows.size, np.zeros(rows.size)
        p = softmax(scores_of(weighted(rows, idf), w) / heat) if len(names) > 1 else np.ones((rows.size, 1))
        best = p.argmax(axis=1)
        return [names[b] if ok else "und" for b, ok in zip(best.tolist(), written, strict=True)], np.where(written, p.max(axis=1), 0.0)

    out = score_rows(docs, vector, scores, {"lang_pred": "string", "score": "double"})
    return out.select("doc_id", F.coalesce(is_held_out("doc_id", modulus, remainder), F.lit(False)).alias("held_out"), "lang_pred", "score")
