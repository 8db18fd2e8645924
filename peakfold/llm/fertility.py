"""Quality rules by tokeniser fertility: how a public vocabulary takes a text apart.

Characters per token, the share of byte-fallback tokens and the entropy of tokens are held against
bands that depend on the text's script. Counts of words, symbols, repeated lines and windows go along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import IdMemo, bytes_of, gather, id_text, is_held_out, map_arrow, out_batch, shipped_file, slices
from peakfold.llm.neardup import mix

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
SPACE, SYMBOLS, LATER = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
#: Tokens up to which the entropy that a text could have grows with its length.
ENTROPY_TOKENS = 400
#: Where a band's bounds lie in the texts that it is measured on, and how many of these it takes at least.
TAIL, LEAST_ROWS = 0.001, 1000
#: Least and most characters per token, most byte-fallback share, least share of the entropy that as many tokens
#: could have. Latin: the least two are measured_bands() of sf0.1's labelled good texts without the held-out fold
#: (2,573 rows: 1.801 and 0.713). Greek, Cyrillic, Arabic and CJK occur in no table; theirs lie between a passage of
#: natural text (bytes up to 0.10; 0.86, 2.39, 0.93, 0.72 characters per token) and code points at random (bytes
#: 0.67 and more; 0.57, 0.59, 0.52, 0.33). Lead bytes of "indic" are also those of scripts that the vocabulary has
#: bytes alone for, as is "other": these stay wide.
BANDS = {"latin": (1.8, 8.0, 0.25, 0.713), "greek": (0.65, 6.0, 0.3, 0.35), "cyrillic": (1.1, 7.0, 0.3, 0.45), "arabic": (0.65, 6.0, 0.35, 0.35), "indic": (0.3, 6.0, 0.9, 0.175), "cjk": (0.5, 4.0, 0.4, 0.35), "other": (0.25, 8.0, 0.95, 0.175)}
#: Lead bytes in UTF-8 by script; letters of ASCII are Latin.
LEADS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3], "arabic": [*range(0xD8, 0xDC)], "indic": [0xE0], "cjk": [*range(0xE3, 0xEE)]}
_SCRIPTS = [*LEADS, "other"]
_LEAD_OF = np.zeros((256, len(LEADS)))
for _k, _leads in enumerate(LEADS.values()):
    _LEAD_OF[_leads, _k] = 1


def script_of(raw: bytes) -> str:
    """The script of most letters; "other" for a text without any of those known."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _LEAD_OF
    return _SCRIPTS[int(np.argmax(n))] if n.max() else "other"


def repeat_words(codes: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window that occurs twice or more, the first time included."""
    if len(codes) <= window:
        return 0
    h = np.zeros(len(codes) - window + 1, np.uint64)
    for k in range(window):
        h = mix(h ^ codes[k : len(codes) - window + 1 + k].astype(np.uint64))
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


class Fertility:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.memo = IdMemo(lambda words: sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))
        self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    def measure(self, raws: list[bytes]):
        """Per text its words' codes and their tokens; a word is taken as the vocabulary takes it between blanks."""
        memo = self.memo
        codes = memo.call([raw.split() for raw in raws])
        for raw, c in zip(raws, codes, strict=True):
            yield raw, c, gather(memo.flat, memo.starts, memo.lens, c)
        memo.end()


def row(raw: bytes, codes: np.ndarray, tokens: np.ndarray, is_byte: np.ndarray, bands: dict) -> tuple:
    n = len(codes)
    chars = len(raw.translate(None, SPACE + LATER))
    repeat = repeat_words(codes)
    failed = n < 50 or 100 * repeat > 50 * n
    script = script_of(raw)
    if len(tokens):
        _, k = np.unique(tokens, return_counts=True)
        p = k / len(tokens)
        entropy, share, per = float(-(p * np.log2(p)).sum()), float(is_byte[tokens].mean()), chars / len(tokens)
        low, high, most_bytes, least_entropy = bands.get(script, bands["other"])
        fits = low <= per <= high and share <= most_bytes and entropy >= least_entropy * np.log2(min(len(tokens), ENTROPY_TOKENS) + 1)
    else:
        entropy, share, per, fits = 0.0, 0.0, 0.0, False
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup_lines(raw), repeat, failed, bool(not failed and fits), script, len(tokens), per, share, entropy


_models: dict[str, Fertility] = {}


def measured_bands(figures: DataFrame, good: DataFrame, modulus: int = 5, remainder: int = 0, tail: float = TAIL, least: int = LEAST_ROWS) -> DataFrame:
    """A row for each script with enough texts: script, rows, least_chars, most_chars, most_bytes, least_entropy, which
    a share of ``tail`` of these texts passes at most each.

    figures is a result of quality_rules(); good has the doc_id of texts to be kept, of which the fold held out, base
    failures, null keys and repeats don't count. Sums over sorted sketches, so no script is gathered in one place.
    """
    ids = good.select("doc_id").where(F.col("doc_id").isNotNull() & ~is_held_out("doc_id", modulus, remainder)).distinct()
    share = F.col("token_entropy") / F.log2(F.least("n_tokens", F.lit(ENTROPY_TOKENS)) + 1)
    at = lambda c, q: F.percentile_approx(c, q, 100_000)
    rows = figures.where("not base_failed and n_tokens > 0").join(ids, "doc_id").groupBy("script")
    found = rows.agg(F.count("*").alias("rows"), at("chars_per_token", tail).alias("least_chars"), at("chars_per_token", 1 - tail).alias("most_chars"), at("byte_share", 1 - tail).alias("most_bytes"), at(share, tail).alias("least_entropy"))
    return found.where(F.col("rows") >= least)


def quality_rules(docs: DataFrame, model: str, bands: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the counts, the base verdict, fertility figures and whether the text is kept.

    model is a file of the driver; the executors get it. A row without text, or without words, counts as
    0 words: base_failed, not kept, figures 0. A text of any length is measured whole; words of more than
    IdMemo.LONGEST bytes aren't kept in memory. Rows are independent: repeated rows and null keys go
    through as they are, an empty table gives no rows; other columns are not looked at. Of scripts with
    equally many letters the first of LEADS counts. A script without a band of its own has that of "other".
    """
    bands, file = BANDS | (bands or {}), shipped_file(docs.sparkSession, model, "pieces")
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema([(f.split(" ")[0], k) for f, k in zip(SCHEMA.split(", "), kinds, strict=True)])

    def run(batches):
        if (at := file.path()) not in _models:
            _models[at] = Fertility(at)
        f = _models[at]
        for batch in slices(batches):
            rows = [row(raw, c, t, f.is_byte, bands) for raw, c, t in f.measure(bytes_of(batch))]
            yield out_batch(schema, batch.column("doc_id"), *map(list, zip(*rows, strict=True)))

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA)
