"""The pipeline's stages by row, samples, and operators on very long, empty and clashing input."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from peakfold.llm import bpe, common, features, fertility, htmltext, langid, media, neardup, packing, quality, secrets, toxicity

ROW = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id string, _ROW int, _k int, kept boolean, score double"


def corpus(spark, extra=()):
    """Good and bad, clean and toxic texts, with repeated rows and keys, null keys and texts."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for k in range(300):
        w = [word() for _ in range(40)]
        toxic, good = int(k % 6 == 0), int(k % 4 > 0)
        w += ["vilebad", "hateful"] if toxic else []
        rows.append((k, " ".join(w if good else [x + "$#" for x in w])))
        labels.append((k, good, toxic))
    clean, bad = " ".join(word() for _ in range(40)), " ".join(word() + "$#" for _ in range(40))
    rows += [(1000, clean), (1000, bad), (1000, bad), (None, bad), (None, clean), (None, None), (1001, None), (1002, ""), (1003, clean), (1003, clean), *extra]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", "y", 7, 1, True, 0.5) for k, t in rows], ROW)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), clean, bad


@pytest.fixture
def sf(spark, tmp_path):
    docs, labels, clean, bad = corpus(spark, [(2000, "word " * 300_000), (2001, "x" * 400_000)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), clean, bad


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_stages_by_row(spark, sf):
    base, clean, bad = sf
    docs = spark.read.parquet(f"{base}/documents.parquet")
    texts = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    labels = spark.read.parquet(f"{base}/labels.parquet")

    good = corpus_pipeline.quality_stage(spark, docs, base)
    assert good.columns == docs.columns and good.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    found = rows_of(good)
    assert (1000, clean) in found and (1000, bad) not in found and (None, clean) in found and (None, bad) not in found
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    values, scores = quality._scorer(common.id_text(docs), ratings, features.CharVector((1, 2, 3), 15), None, 0.5, 5, 0)
    one = lambda t, vector: features.Rows(vector.rows(common.pa.record_batch([common.pa.array([t])], names=["text"])), vector.width)
    every = rows_of(docs)
    assert found == [(k, t) for k, t in every if scores(one(t, features.CharVector((1, 2, 3), 15)))[2][0]]

    clean_rows = corpus_pipeline.toxicity_stage(spark, docs, base)
    score = {(r.doc_id, r.text): r.predicted for r in toxicity.score_toxicity(docs, labels).join(texts.limit(0), "doc_id", "left").select("doc_id", F.lit(None).cast("string").alias("text"), "predicted").collect()}
    kept = {k for k, _ in rows_of(clean_rows)}
    assert all(k in kept for (k, _), p in score.items() if p == 0) and not any(k in kept for (k, _), p in score.items() if p == 1)
    assert len([k for k in kept if k is not None and k < 300]) == 250

    some = docs.where("doc_id is null or doc_id >= 1000 or doc_id < 20")
    first = rows_of(corpus_pipeline.neardup_stage(spark, some, base))
    assert first.count((1000, clean)) == 1 and first.count((1000, bad)) == 1 and (1003, clean) not in first
    assert (1001, None) in first and (1002, "") in first and len([x for x in first if x[0] is None]) == 3
    assert [k for k, _ in first if k is not None and k < 20] == list(range(20))
    assert corpus_pipeline.neardup_stage(spark, some.limit(0), base).count() == 0

    same = corpus_pipeline.secrets_stage(spark, some, base)
    assert same.columns == docs.columns and rows_of(same) == rows_of(some)
    assert same.where("_ROW <> 7 or _k <> 1 or _id <> 'y'").count() == 0
    pieces = corpus_pipeline.packing_stage(spark, some.where("doc_id >= 1000"), base).collect()
    whole = {r.doc_id: r.doc_tokens for r in pieces}
    assert whole[1001] == whole[1002] == 1 and sum(r.length for r in pieces if r.doc_id == 2000) == whole[2000] == 300_001


def test_run(spark, sf):
    base, clean, _ = sf
    pieces = corpus_pipeline.run(spark, base)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id is None, r.doc_id or 0, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = {}
    for x in pieces.collect():
        got.setdefault((x.doc_id is None, x.doc_id or 0), []).append(x)
    assert {k[:2] for k in want} == set(got)
    assert sum(x.length for v in got.values() for x in v) == sum(k[2] for k in want)


def test_stages_of_empty_tables(spark, sf, tmp_path):
    base = str(tmp_path / "none")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf[0]}/{name}.parquet").limit(0).write.parquet(f"{base}/{name}.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0


def test_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], ROW)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, grade double, lang string")
    path = public_tokenizers.path
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (bpe.encode_documents(docs, path("byte_bpe_50k.json")), media.store_documents(docs), secrets.scan(docs), secrets.redact(docs), htmltext.extract_pages(pages), quality.score_quality(docs, none), toxicity.score_toxicity(docs, none), fertility.quality_rules(docs, path("piece_bpe_32k.model")), neardup.near_duplicates(docs), langid.identify(docs, none), packing.pack_documents(docs, path("word_bpe_49k.json"))):
        assert df.count() == 0


def test_redaction_leaves_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(1, "é token=deadbeef01234567x end", 7, 8, 9, "s"), (None, "token=deadbeef01234567y", 1, 2, 3, None), (2, None, 4, 5, 6, "s"), (2, "", 4, 5, 6, "s")], "doc_id long, text string, _row int, row int, live int, source string")
    got = {(r.doc_id, r.text): (r["_row"], r["row"], r["live"]) for r in secrets.redact(docs).collect()}
    assert got == {(1, "é <secret> end"): (7, 8, 9), (None, "<secret>"): (1, 2, 3), (2, None): (4, 5, 6), (2, ""): (4, 5, 6)}


def test_many_matches_in_one_text(spark):
    n = 8000
    token = lambda k: f"{k * 2654435761 % (1 << 32):08x}" * 4
    text = "é ".join(token(k) for k in range(n))
    at = [k * 34 for k in range(n)]
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    began = time.time()
    r = secrets.scan(docs).first()
    assert time.time() - began < 40 and r.n_hex == n
    spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("hex")]
    assert spans == [(a, a + 32) for a in at]


def test_values_copied_everywhere_and_once(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HOT", 4)  # the common value is broadcast, the others joined
    common_value, rows = "Ab7Zq8Lm2Xw5Rt9Vb3Nc6Yd1", []
    for k in range(40):
        rows.append((k, f"see {common_value} and Zq{k:02d}Lm2Xw5Rt9Vb3Nc6Yd1aa end", f"o{k}"))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all((r.n_copied, r.n_owned) == (1, 1) for r in got) and len(got) == 40


def test_long_texts_leave_nothing_in_memory():
    path = public_tokenizers.path("byte_bpe_50k.json")
    v = bpe.Vocabulary(path)
    e, t, r = bpe.Encoder(v, bpe.vocabulary_lexicon(v)), Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000)) for _ in range(20)] + ["a b", "x" * 3000, "".join(r.choice("abcde") for _ in range(5000))]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.memo.pieces == len(e.memo.numbers) == 2 and e.memo.used < 10
    for w in (b"abc" * 400, b"a" * 901, "éèß汉字".encode() * 100):
        assert v.merge_long(w) == v.merge(w) == v.merge_many([w])[0]


def test_memo_starts_anew_at_its_bound(monkeypatch):
    monkeypatch.setattr(common.IdMemo, "MOST_BYTES", 2000)
    memo = common.IdMemo(lambda pieces: [[ord(c) for c in p] for p in pieces])
    r = random.Random(1)
    for _ in range(30):
        texts = [["ab" * r.randrange(50), str(r.randrange(99)), "z"] for _ in range(5)]
        assert [x.tolist() for x in memo.ids(texts)] == [[ord(c) for p in t for c in p] for t in texts]
        assert memo.pieces < 30


def test_letters_newer_than_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    v = bpe.Vocabulary(path)
    e, t, r = bpe.Encoder(v, bpe.vocabulary_lexicon(v)), Tokenizer.from_file(path), random.Random(5)
    pool = [chr(c) for c in (0x16EA0, 0x558, 0x11DE0, 0x61, 0x31, 0x20, 0x27, 0x73, 0x4E2D, 0xA0, 0x0A, 0x300)]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(30))) for _ in range(1500)]
    assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<p>x</p>" + "<a " * 350_000, '<a href="x>te</a> ' * 50_000, "<!-- " * 200_000, "<script " * 100_000, "<script>" + "</script " * 100_000, "<textarea>" * 100_000, "<b 'x\">" * 100_000])
def test_open_markup_takes_linear_time(page):
    began = time.time()
    _, blocks = htmltext.parse(page)
    assert time.time() - began < 3 and all("<a" not in t for _, t in blocks)


def test_unclosed_quotes_and_tags():
    assert [t for _, t in htmltext.parse('<p>one <a href="x>text</a> two</p><p>three</p>')[1]] == ["one text two", "three"]
    assert [t for _, t in htmltext.parse("<p>a < b</p><p title='>'>c</p><p>d <b")[1]] == ["a < b", "c", "d"]


def test_pages_with_names_that_no_template_has():
    """Parts are told by their elements where names say nothing."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubcdlmnr") for _ in range(r.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    right = n = 0
    for _ in range(60):
        odd = lambda: f' class="{word()}-{word()} {word()}"'
        body = [words(r.randint(8, 40)) for _ in range(r.randint(2, 6))]
        page = f"<html><body><header{odd()}><h1>{words(2)}</h1></header><nav{odd()}><ul>" + "".join(f"<li><a href=/>{word()}</a></li>" for _ in range(6)) + f"</ul></nav><article{odd()}>" + "".join(f"<p>{b}</p>" for b in body) + f"</article><aside{odd()}><p>{words(9)}</p></aside><footer{odd()}><p>{words(5)}</p></footer></body></html>"
        right += htmltext.extract(page, htmltext.default_model()) == "\n".join(body)
        n += 1
    assert right >= 0.95 * n


def test_bounded_samples(spark):
    rows = spark.range(30_000).select((F.col("id") % 20_000).alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("hot").alias("lang"))
    got = features.bounded(rows, "lang", 100, 150).collect()
    by = {x: [r.doc_id for r in got if r.lang == x] for x in ("hot", "rare")}
    assert len(got) == 150 and abs(len(by["hot"]) - len(by["rare"])) <= 1
    have = rows.where("lang = 'hot'").select("doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1)).alias("h")).distinct().orderBy("h").limit(len(by["hot"])).collect()
    assert set(by["hot"]) == {r.doc_id for r in have}
    assert features.bounded(rows, "lang", 100, 150, most=1).select("lang").distinct().collect()[0].lang == "hot"
    assert features.bounded(rows.limit(0), "lang", 10, 10).count() == 0


def test_features_are_chosen_as_on_the_driver(spark):
    docs, labels, *_ = corpus(spark)
    vector = features.WordVector(inner=4)
    keys = labels.select("doc_id", F.col("toxic").alias("kind"), (F.col("doc_id") % 2).cast("int").alias("half"))
    sample = features.sample_texts(common.id_text(docs), keys, ["kind", "half"])
    got = toxicity.worth_gathering(sample, vector)
    rows, kinds = features.gather_rows(sample, vector, ["kind", "half"])
    on, half = np.array([k[0] == 1 for k in kinds]), np.array([k[1] for k in kinds])
    want = [toxicity.informative(rows.take(on & m), rows.take(~on & m)) for m in (half >= 0, half == 0, half == 1)]
    assert got.tolist() == sorted(set(np.concatenate(want).tolist())) and len(got)
    few, _ = features.gather_rows(sample, vector, ["kind", "half"], most=5000)
    assert 0 < len(few.at) <= 5000


def test_many_grades_are_put_into_ranges(spark):
    learn = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 1000 / 10).alias("grade"))
    of, classes = quality.grade_classes(learn)
    assert len(classes) == quality.MOST_GRADES and sum(n for _, n in classes.values()) == 5000
    values = [v for v, _ in classes.values()]
    assert values == sorted(values) and max(n for _, n in classes.values()) < 400
    few, three = quality.grade_classes(spark.createDataFrame([(1, 1.0), (2, 3.5), (3, 2.0), (4, 2.0)], "doc_id long, grade double"))
    assert three == {0: (1.0, 1), 1: (2.0, 2), 2: (3.5, 1)}


def test_ordinal_likelihood_against_a_plain_version():
    """Training lowers the negative log-likelihood of grades, computed row by row."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 200)
    rows = features.Rows([(np.array([0, 1 + k % 2]), np.array([g + rng.normal() / 2, 0.2], np.float32)) for k, g in enumerate(y)], 3)

    def loss(w, cuts):
        total = 0.0
        for k, s in enumerate(rows.dot(w)):
            t = [-np.inf, *cuts, np.inf]
            at = lambda x: 1 / (1 + np.exp(-x)) if np.isfinite(x) else float(x > 0)
            total -= np.log(at(t[y[k] + 1] - s) - at(t[y[k]] - s))
        return total / len(y)

    w, cuts = quality.train(rows, y, 3, np.ones(3))
    assert loss(w, cuts) < 0.75 * loss(np.zeros(3), [-0.7, 0.7])
    for j in range(3):  # no small step of one weight is much better
        for e in (-0.3, 0.3):
            v = w.copy()
            v[j] += e
            assert loss(v, cuts) > loss(w, cuts) - 0.02


def test_positive_unlabelled_risk_against_a_plain_version():
    """The gradient of a step equals that of the risk by finite differences."""
    rng = np.random.default_rng(4)
    make = lambda n, c: features.Rows([(np.arange(3), (rng.normal(size=3) + c).astype(np.float32)) for _ in range(n)], 3)
    p, u, prior = make(40, 1.0), make(80, 0.0), 0.3
    w, bias = toxicity.train(p, u, prior, steps=400)

    def risk(w, b):
        log = lambda z: np.logaddexp(0, z).mean()
        zp, zu = p.dot(w) + b, u.dot(w) + b
        return prior * log(-zp) + max(0.0, log(zu) - prior * log(zp)) + 1e-3 * (w @ w) / 2

    at = risk(w, bias)
    assert at < risk(np.zeros(3), np.log(prior / (1 - prior)))
    for j in range(3):
        for e in (-0.4, 0.4):
            v = w.copy()
            v[j] += e
            assert risk(v, bias) > at - 0.02


def test_leader_against_a_plain_version():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.permutation(6)[:3]), rng.random(3)) for _ in range(30)]
    leader = langid.Leader(6, 3)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    for k, (at, value) in enumerate(rows):
        w = np.zeros((6, 3))
        for i in range(6):
            for j in range(3):
                if abs(z[i, j]) > 0.01:
                    w[i, j] = -(z[i, j] - np.sign(z[i, j]) * 0.01) / ((1 + np.sqrt(n[i, j])) / 1.0 + 0.1)
        s = [sum(value[a] * w[i, j] for a, i in enumerate(at)) for j in range(3)]
        p = np.exp(s - np.max(s)) / np.exp(s - np.max(s)).sum()
        for a, i in enumerate(at):
            for j in range(3):
                g = value[a] * (p[j] - (j == k % 3))
                z[i, j] += g - (np.sqrt(n[i, j] + g * g) - np.sqrt(n[i, j])) * w[i, j]
                n[i, j] += g * g
        leader.learn(at, value, k % 3)
    assert leader.z == pytest.approx(z) and leader.n == pytest.approx(n)


def test_fertility_figures_equal_the_vocabulary(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Rivers carry sand and stone to wide plains", "é 日本語 ✓ \U0001f600 x", "a1 b2 $$ " * 20 + "end"]
    for r in fertility.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect():
        ids = sp.encode(texts[r.doc_id])
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        assert r.n_tokens == len(ids) and r.chars_per_token == pytest.approx(r.word_chars / len(ids))
        assert r.byte_share == pytest.approx(np.mean([sp.is_byte(i) for i in ids])) and r.token_entropy == pytest.approx(-(share * np.log2(share)).sum())


def test_packing_keeps_the_limit_on_loss(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    mask = packing.word_mask(path)
    docs = spark.createDataFrame([(k, "word and more words " * (30 + 7 * k) + ". ! " * k) for k in range(60)], "doc_id long, text string")
    t, by = Tokenizer.from_file(path), {}
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 2]) for r in docs.collect()}
    for x in packing.pack_documents(docs.coalesce(1), path, loss=3000, loss_mask=mask).collect():
        by.setdefault(x.sequence_id, []).append(ids[x.doc_id][x.start : x.start + x.length])
    sizes = [(sum(map(len, v)), int(sum(mask(p).sum() for p in v))) for v in by.values()]
    assert sum(n for n, _ in sizes) == sum(map(len, ids.values()))
    assert all(n <= 4096 and n & (n - 1) == 0 and loss <= 3000 for n, loss in sizes) and max(loss for _, loss in sizes) > 1500


def track_box(*tables, number=7):
    n = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    stbl = media.box(b"stbl", media.full(b"stsd", n(1), media.box(b"avc1", bytes(78))), media.full(b"stts", n(0)), *tables)
    tkhd = media.full(b"tkhd", n(0, 0, number), bytes(68))
    return media.box(b"trak", tkhd, media.box(b"mdia", media.full(b"mdhd", n(0, 0, 90, 40, 0)), media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", stbl)))


def test_compact_sizes_fragments_and_broken_tables():
    n = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    stsc, stco = media.full(b"stsc", n(1, 1, 3, 1)), media.full(b"stco", n(1, 500))
    for bits, raw in ((4, b"\x57\x90"), (8, b"\x05\x07\x09"), (16, b"\0\x05\0\x07\0\x09")):
        (t,) = media.read_tracks(media.box(b"moov", track_box(stsc, stco, media.full(b"stz2", n(bits), n(3), raw))))
        assert t["sizes"].tolist() == [5, 7, 9] and t["starts"].tolist() == [500, 505, 512] and t["keyframe_ranges"] == [[500, 521]]
    empty = (media.full(b"stsc", n(0)), media.full(b"stsz", n(0, 0)), media.full(b"stco", n(0)))
    trex = media.box(b"mvex", media.full(b"trex", n(7, 1, 10, 4, media.NOT_SYNC)))
    moov = media.box(b"moov", track_box(*empty), trex)
    tfhd = media.full(b"tfhd", n(7), flags=0x20000)
    runs = media.full(b"trun", n(3), n(100), n(0), flags=media.RUN_OFFSET | media.RUN_FIRST) + media.full(b"trun", n(2), n(6, 0, 8, media.NOT_SYNC), flags=media.RUN_SIZE | media.RUN_FLAGS)
    (t,) = media.read_tracks(moov + media.box(b"moof", media.full(b"mfhd", n(1)), media.box(b"traf", tfhd, runs)))
    base = len(moov)
    assert t["sizes"].tolist() == [4, 4, 4, 6, 8] and t["starts"].tolist() == [base + x for x in (100, 104, 108, 112, 118)]
    assert t["keyframe_ranges"] == [[base + 100, base + 104], [base + 112, base + 118]] and t["duration"] == 90
    sizes = media.full(b"stsz", n(0, 3, 5, 7, 9))
    for tables in ((stsc, stco), (stsc, sizes), (stsc, stco, media.full(b"stsz", n(0, 900, 5))), (media.full(b"stsc", n(0)), stco, sizes), (stsc, stco, sizes, media.full(b"stss", n(1, 4)))):
        with pytest.raises(ValueError):
            media.read_tracks(media.box(b"moov", track_box(*tables)))


def test_toxicity_prior_is_of_the_rows_that_are_there(spark):
    """Labels of rows that an earlier stage rejected neither count in the prior nor take places in the sample."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows = [(k, " ".join([word() for _ in range(9)] + (["vilebad"] if k % 3 == 0 else []))) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    here = [(k, int(k % 3 == 0)) for k in range(240)]
    score = lambda labels: {x.doc_id: x.score for x in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    want = score(here)
    assert score(here + [(k, int(k % 50 == 0)) for k in range(1000, 3000)]) == pytest.approx(want)
    assert min(want[k] for k, toxic in here if toxic) > 0.5
