"""Mixing, alignment of tokenizers and resampling against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from peakfold.llm import alignment, common, mixing, resample
from tests.llm.test_llm import ODD, table

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, size int, target int, weight int, _p int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], SCHEMA)


# Mixing -----------------------------------------------------------------------------------------------


def plain_targets(size_of: dict) -> dict:
    """Shares by weight; what is above a cap goes to the others, until none is above."""
    names = sorted(size_of, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    rest, out = 1.5 * sum(size_of.values()), {}
    while open_ := [s for s in names if s not in out]:
        level = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level >= 2 * size_of[s]]
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = 2.0 * size_of[s]
            rest -= out[s]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "a", "b", "Z", "hot", "none"]
    rows = [(k, " ".join(["wort"] * rng.randrange(0, 60)), rng.choice(names[:-1]) if rng.random() < 0.5 else "hot") for k in range(600)]
    rows += [(900, None, "none"), (901, "", "none"), (None, "ein wort", "a"), (None, None, None), (902, "x " * 5000, "b"), (5, "noch ein", "a"), rows[3], rows[3]]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size_of, taken = Counter(), Counter()
    for k, t, s in rows:
        size_of[s] += len(re.findall(mixing.WORD, t or ""))
    want = plain_targets(size_of)
    by_target = {round(want[s], 6): s for s in want}
    for r in got:
        s = by_target[round(r.target, 6)]
        assert r.source_size == size_of[s] and r.taken in (r.epochs * r.size, (r.epochs + 1) * r.size) and r.taken <= 2 * r.size
        taken[s] += r.taken
    longest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in size_of}
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs(spark, rows).repartition(7)).collect()))  # reruns agree


def test_mixing_follows_keys_and_weights(spark):
    from pyspark.sql import functions as F

    rows = [(k, "eins zwei" if k % 2 else "eins 22", "s") for k in range(4000)]
    got = {r.doc_id: r.taken for r in mixing.mix(docs(spark, rows), weight=F.when(F.col("doc_id") % 2 == 1, 4.0).otherwise(1.0), total=0.25).collect()}
    odd, even = (sum(got[k] > 0 for k in range(p, 4000, 2)) for p in (1, 0))
    assert odd + even == 1000 and odd > 3 * even
    assert not mixing.mix(docs(spark, rows).limit(0)).collect()
    assert {r.taken for r in mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}
    none = mixing.mix(docs(spark, rows[:10]), weight=F.lit(None).cast("double"), total=0.5).collect()
    assert sum(r.taken for r in none) == 10


def test_ordered(spark):
    rows = [(k % 17, k, k * k) for k in range(500)]
    random.Random(1).shuffle(rows)
    with common.scratch(spark):
        got = common.ordered(spark.createDataFrame(rows, "x long, y long, z long"), ["x", "y"], {"before": "z"}).collect()
    total = 0
    for place, r in enumerate(sorted(got, key=lambda r: (r.x, r.y))):
        assert (r.place, r.before) == (place, total)
        total += r.z


# Alignment of tokenizers ------------------------------------------------------------------------------

_TOKENIZER = Tokenizer.from_file(BYTE)
_TOKENIZER.encode_special_tokens = True
_SP = sentencepiece.SentencePieceProcessor(model_file=PIECE)


def _bytes_of_levels() -> dict:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_LEVEL = _bytes_of_levels()


def plain_alignment(texts):
    """Per text (n_a, n_b, groups); ends of tokens as sets."""
    out = []
    for t in texts:
        a, b = _TOKENIZER.encode(" " + (t or ""), add_special_tokens=False).ids, _SP.encode(t or "")
        raw = b" " + (t or "").encode()
        left = [bytes(_LEVEL[c] for c in _TOKENIZER.id_to_token(i)) for i in a]
        right = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(_SP.id_to_piece, b)]
        if not t or b"".join(left) != raw or b"".join(right) != raw:
            out.append((0, 0, []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        out.append((len(a), len(b), groups))
    return out


def plain_links(texts):
    found = plain_alignment(texts)
    count = Counter(p for _, _, groups in found for p in {(x, y) for a, b in groups for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = []
    for n_a, n_b, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = " \n\t  ab xyz 　é日本語语✓😀▁́<|endoftext|><s></s>\x00\x1c01 27"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_pieces_equal_the_library():
    texts = [t for t in odd_texts(3000) if "▁" not in t] + [" ", "  ", "x ", " x", "   a   ", "a" * 5000, "ab" * 3000 + " " * 900, ""]
    got = alignment.Pieces(PIECE)
    assert got.apart and [x.tolist() for x in got.encode(texts)] == _SP.encode(texts)


def test_overlay_by_windows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        lens = [np.diff(np.sort(np.unique(np.concatenate([[0, total], rng.integers(0, total + 1, rng.integers(0, 30))])))) for _ in range(2)]
        want = alignment.overlay(*lens)
        owner = [np.repeat(np.arange(len(x)), x) for x in lens]
        assert list(zip(want[0], want[1], strict=True)) == list(dict.fromkeys(zip(*(o.tolist() for o in owner), strict=True)))
        cuts = sorted(set(np.cumsum(lens[0])) & set(np.cumsum(lens[1])))
        for k in (0, 1):
            assert want[2 + k].tolist() == np.searchsorted(cuts, np.cumsum(lens[k])).tolist()
        for window in (1, 2, 7):
            assert all((x == y).all() for x, y in zip(want, alignment.overlay(*lens, window=window), strict=True))


@pytest.mark.parametrize("wide", [4096, 1])
def test_links(spark, monkeypatch, wide):
    texts = ODD + odd_texts(150, 2) + ["the cat sat", "the cat sat on the mat", "the cat sat", "▁x", "日本語" * 400]
    monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
    frame = table(spark, texts)
    extra = [(None, "no key at all"), (len(texts) - 1, texts[-1])]
    want = plain_links([*texts, *(t for _, t in extra)])
    keys = [*range(len(texts)), *(k for k, _ in extra)]
    for block in (alignment.BLOCK_PAIRS, 300):
        got = alignment.link_documents(frame, BYTE, PIECE, block_pairs=block).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, *w)) for k, w in zip(keys, want, strict=True))
    assert not alignment.link_documents(frame.limit(0), BYTE, PIECE).collect()


def test_linked_wide_groups_equal_narrow_ones(monkeypatch):
    rng = np.random.default_rng(5)
    group_a, group_b = np.sort(rng.integers(0, 40, 600)), np.sort(rng.integers(0, 40, 500))
    ids_a, ids_b, row_of = rng.integers(0, 30, 600), rng.integers(0, 25, 500), np.sort(rng.integers(0, 6, 40))
    want = Counter((int(row_of[g]), int(x) * 25 + int(y)) for g in range(40) for x in ids_a[group_a == g] for y in ids_b[group_b == g])
    for wide, step in ((4096, 2_000_000), (100, 50), (0, 7)):
        monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
        monkeypatch.setattr(alignment, "STEP_LINKS", step)
        row, code, n = alignment.linked(ids_a, ids_b, group_a, group_b, row_of, 6, 25)
        assert {(int(r), int(c)): int(k) for r, c, k in zip(row, code, n, strict=True)} == want


def test_alignments(spark):
    texts = ["the cat<|endoftext|>", "日本 x", None, ""]
    got = {r.doc_id: r for r in alignment.align_documents(table(spark, texts), BYTE, PIECE).collect() if r.doc_id is not None}
    for k, (n_a, n_b, groups) in enumerate(plain_alignment(texts)):
        r = got[k]
        assert (len(r.ids_a), len(r.ids_b)) == (n_a, n_b)
        for g, (a, b) in enumerate(groups):
            assert [x for x, y in zip(r.ids_a, r.group_a, strict=True) if y == g] == a and [x for x, y in zip(r.ids_b, r.group_b, strict=True) if y == g] == b
        assert all(r.group_a[o.a] == r.group_b[o.b] for o in r.overlaps) and len({(o.a, o.b) for o in r.overlaps}) == len(r.overlaps) >= max(n_a, n_b)


# Resampling -------------------------------------------------------------------------------------------


def plain_resample(rows, target, n, buckets, percent, least):
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[k : k + d]) for d in range(1, n + 1) for k in range(len(w) - d + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    split = [runs(t) for _, t, _ in rows]
    s = Counter(bucket(x) for _, f in split for x in f)
    t = Counter(bucket(x) for text in target for x in runs(text)[1])
    total = [sum(s.values()), sum(t.values())]
    out = []
    for (k, _, _), (words, f) in zip(rows, split, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total[0] + buckets) / ((s[b] + 1) * (total[1] + buckets)))) for b in map(bucket, f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    long_ = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, r in enumerate(long_[: percent * len(long_) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("words,buckets,nodes", [(1, 10_000, 1_000_000), (1, 50, 3), (3, 1000, 40), (2, 10_000, 1_000_000)])
def test_resample(spark, monkeypatch, words, buckets, nodes):
    monkeypatch.setattr(resample, "MOST_NODES", nodes)
    rng = random.Random(words)
    vocab = ["Ab", "cd", "É", "日本", "e1", "x-y", "[z]", "Straße"]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 50))), "s") for k in range(300)]
    rows += [(None, None, None), (400, "", "s"), (401, "\x00{}[]", "s"), (402, "ab " * 4000, "s"), (None, "ab " * 30, "s")]
    target = ["cd cd e1", None, "", "日本 É nie gesehen"]
    goal = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, n int")
    got = resample.resample(docs(spark, rows), goal, words=words, buckets=buckets, percent=30, least_words=12).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_resample(rows, target, words, buckets, 30, 12)))


def test_resample_of_empty_tables(spark):
    goal = spark.createDataFrame([], "text string")
    assert not resample.resample(docs(spark, []), goal).collect()
    rows = [(k, "a b " * 20, "s") for k in range(30)] + [(3, "a b " * 20, "s")]
    got = resample.resample(docs(spark, rows), goal).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and len(got) == 31
