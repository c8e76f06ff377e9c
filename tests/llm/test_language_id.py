import math
import random
import tracemalloc
import zlib

import numpy as np

from quillgrid.llm import language_id
from tests.llm.frames import awkward_documents, empty_documents


def corpus(spark, n=300):
    rnd = random.Random(2)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["ler", "sch", "ung"], "cc": ["eau", "oui", "çé"], "dd": ["ción", "ado", "eñ"], "ee": ["ox", "iq", "wu"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(syllables))
        rows.append((i, " ".join("".join(rnd.choices(syllables[lang], k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    frame = corpus(spark)
    truth = {r.doc_id: r.lang for r in frame.collect()}
    rows = language_id.digest(frame).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_awkward_rows(spark):
    frame = awkward_documents(spark)
    rows = language_id.digest(frame).collect()
    assert len(rows) == frame.count()
    texts = [r.text for r in frame.collect() if r.text is None or not any(c.isalpha() for c in r.text)]
    assert sum(r.lang_pred == "und" for r in rows) == len(texts)
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}


def test_nothing_to_learn_from(spark):
    assert language_id.digest(empty_documents(spark)).count() == 0
    frame = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.digest(frame).collect()} == {"und"}
    frame = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(12)] + [(50, "12 34 --", "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language_id.digest(frame).collect()}
    assert rows[3].lang_pred == "en" and rows[3].score == 1.0 and rows[50].lang_pred == "und"


def test_codewords_are_apart():
    for n in (2, 4, 10, 60):
        code = language_id.codewords(n)
        distance = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert distance >= code.shape[1] // 5 and not (np.abs(code.sum(0)) == n).any()


def test_grams_do_not_cross_words():
    a, n = language_id._grams([b"ab", b"cde", b"f"], 1 << 20)
    alone = [language_id._grams([w], 1 << 20)[0].tolist() for w in (b"ab", b"cde", b"f")]
    parts = np.split(a, np.cumsum(n)[:-1])
    assert [sorted(p.tolist()) for p in parts] == [sorted(x) for x in alone] and n.tolist() == [7, 10, 4]


def test_texts_of_any_length_are_learnt_from(spark):
    frame = corpus(spark)
    rows = [(r.doc_id, (r.text + " ") * (4000 if r.lang == "cc" and r.doc_id % 7 == 0 else 1), r.lang) for r in frame.collect()]
    rows = [r for r in rows if r[2] != "cc" or r[0] % 7 == 0]  # a language with long texts only
    got = {r.doc_id: r.lang_pred for r in language_id.digest(spark.createDataFrame(rows, frame.schema)).collect()}
    assert np.mean([got[d] == lang for d, _, lang in rows]) > 0.95


def test_the_sample_is_bounded_and_the_same_again(spark):
    frame = corpus(spark)
    rows = frame.union(frame).union(frame.select("doc_id", "text", language_id.F.lit("zz")))  # repeated texts, a text under two languages
    labelled = rows.withColumn("order", language_id.F.xxhash64("text"))
    taken = language_id._chosen(labelled, 10, 1000, 100).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in taken} == dict.fromkeys(["aa", "bb", "cc", "dd", "ee", "zz"], 10)
    assert language_id._chosen(labelled, 10, 12, 100).count() == 12
    assert {r.lang for r in language_id._chosen(labelled, 10, 1000, 2).collect()} == {"aa", "bb"}
    a, b = language_id.fit(frame), language_id.fit(frame.repartition(5))
    assert np.array_equal(a.weights, b.weights) and a.languages == b.languages


def test_hundred_languages_fit_in_little_memory(spark):
    rnd = random.Random(4)
    rows = []
    for lang in range(100):
        own = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)]
        rows += [(f"l{lang}", " ".join("".join(rnd.choices(own, k=2)) for _ in range(30))) for _ in range(12)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    tracemalloc.start()
    model = language_id.fit(frame, steps=120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 100 and peak < 200e6  # all rows dense at once would be 40 MB for each copy, and grow with them
    margins = model.margins([language_id._words(t.encode()) for _, t in rows[::7]])
    assert np.mean([model.languages[b] == lang for b, (lang, _) in zip(model.decode(margins)[0], rows[::7])]) > 0.9


def test_decoding_is_the_plain_sum_of_losses(spark):
    """Bit by bit and language by language, from n-grams counted one by one."""
    frame = corpus(spark)
    model = language_id.fit(frame)
    for r in frame.limit(20).collect():
        grams = [g for w in language_id._words(r.text.encode()) for g in language_id._grams([w], len(model.weights))[0].tolist()]
        margins = [sum(float(model.weights[g, b]) for g in grams) / len(grams) + float(model.bias[b]) for b in range(model.code.shape[1])]
        losses = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, code.tolist())) for code in model.code]
        best, share, gap = model.decode(model.margins([language_id._words(r.text.encode())]))
        first, second = sorted(losses)[:2]
        assert losses[best[0]] - first < 1e-3
        assert abs(share[0] - 1 / sum(math.exp(first - x) for x in losses)) < 1e-3 and abs(gap[0] - (second - first) / len(margins)) < 1e-3
