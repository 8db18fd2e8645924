"""Bands of fertility by script: natural text stays, code points at random and other junk go; bands from labelled texts."""

import numpy as np
import public_tokenizers
import pytest

from peakfold.llm import fertility

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: The first articles of a public declaration, by script.
PASSAGES = {
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που προκηρύσσει η παρούσα Διακήρυξη, χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες, τις πολιτικές ή οποιεσδήποτε άλλες πεποιθήσεις.",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي أو الثروة أو الميلاد أو أي وضع آخر، دون أية تفرقة بين الرجال والنساء.",
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। सभी को इस घोषणा में सन्निहित सभी अधिकारों और आज़ादियों को प्राप्त करने का हक़ है और इस मामले में जाति, वर्ण, लिंग, भाषा, धर्म, राजनीति या अन्य विचार-प्रणाली, किसी देश या समाज विशेष में जन्म, सम्पत्ति या किसी प्रकार की अन्य मर्यादा आदि के कारण भेदभाव का विचार न किया जाएगा।",
    "cjk": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해, 민족적 또는 사회적 출신, 재산, 출생 또는 기타의 신분과 같은 어떠한 종류의 차별이 없이 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다. 더 나아가 개인이 속한 국가 또는 영토가 독립국, 신탁통치지역, 비자치지역이거나 또는 주권에 대한 여타의 제약을 받느냐에 관계없이 그 국가 또는 영토의 정치적 지위를 근거로 하여 차별이 있어서는 아니된다.",
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status.",
}
#: Blocks of code points by script.
BLOCKS = {"greek": (0x370, 0x400), "cyrillic": (0x400, 0x500), "arabic": (0x600, 0x700), "cjk": (0x4E00, 0xA000), "latin": (0xC0, 0x250)}


def random_words(script, n=200):
    rng = np.random.default_rng(1)
    return " ".join("".join(map(chr, rng.integers(*BLOCKS[script], 6))) for _ in range(n))


def rising(script, n=300):
    first, end = BLOCKS[script]
    return " ".join(chr(first + k % (end - first)) for k in range(n))


def verdicts(spark, texts):
    rows = fertility.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def test_natural_text_stays(spark):
    got = verdicts(spark, PASSAGES.values())
    assert [(r.script, r.base_failed, r.kept) for r in got] == [(k, False, True) for k in PASSAGES]


def test_code_points_at_random_go_by_the_bands(spark):
    got = verdicts(spark, [random_words(k) for k in BLOCKS])
    assert [(r.script, r.base_failed, r.kept) for r in got] == [(k, False, False) for k in BLOCKS]
    assert not any(r.kept for r in verdicts(spark, [rising(k) for k in BLOCKS]))
    assert not verdicts(spark, [rising("cjk")])[0].base_failed


def test_one_letter_words_go(spark):
    got = verdicts(spark, [" ".join(x * (1 + k % 9) for k in range(200) for x in letters) for letters in ("абв", "abc")])
    assert not any(r.kept for r in got)


def test_bands_of_labelled_texts(spark):
    rng = np.random.default_rng(3)
    words = PASSAGES["latin"].split() + PASSAGES["cyrillic"].split()
    texts = [" ".join(rng.permutation(PASSAGES["latin"].split() + list(rng.choice(words[:60], 9)))) for _ in range(60)] + [PASSAGES["greek"]] * 3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (900, "few words"), (901, None)], "doc_id long, text string")
    figures = fertility.quality_rules(docs, VOCABULARY)
    good = spark.createDataFrame([(k,) for k in [*range(63), 5, 5, 900, 901, None]], "doc_id long")
    found = {r.script: r for r in fertility.measured_bands(figures, good, tail=0.1, least=5).collect()}
    held = {r.doc_id for r in good.where("doc_id is not null and crc32(cast(doc_id as string)) % 5 = 0").collect()}
    rows = [r for r in figures.collect() if r.doc_id is not None and r.doc_id < 60 and r.doc_id not in held]
    per = sorted(r.chars_per_token for r in rows)
    assert set(found) == {"latin"} and found["latin"].rows == len(rows)
    at = lambda x, q: sorted(x)[int(np.ceil(q * len(x))) - 1]
    assert found["latin"].least_chars == pytest.approx(at(per, 0.1)) and found["latin"].most_chars == pytest.approx(at(per, 0.9))
    share = [r.token_entropy / np.log2(min(r.n_tokens, fertility.ENTROPY_TOKENS) + 1) for r in rows]
    assert found["latin"].least_entropy == pytest.approx(at(share, 0.1))
    assert fertility.measured_bands(figures.limit(0), good).count() == 0
