import math
import random
import zlib

import numpy as np

from quillgrid.llm import toxicity
from tests.llm.frames import awkward_documents, empty_documents


def corpus(spark, n=400):
    rnd = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "rt", "sk")]
    rows, labels = [], []
    for i in range(n):
        text = [" ".join(rnd.choices(words, k=8)) for _ in range(rnd.randint(2, 8))]
        toxic = i % 4 == 0
        if toxic:
            text[rnd.randrange(len(text))] += " " + rnd.choice(["vileness", "vilest", "grubby"]) + " vile"
        rows.append((i, ". ".join(text) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_documents_and_sentences(spark):
    documents, labels, truth = corpus(spark)
    got = toxicity.digest(documents, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    model = toxicity.fit(documents, labels)
    spans = {r.doc_key: r.offending for r in toxicity.score(documents, model).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = [("vil" in texts[i][s.begin : s.end] or "grub" in texts[i][s.begin : s.end]) for i, ss in spans.items() for s in ss]
    assert found and np.mean(found) > 0.95


def test_awkward_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (7, 0), (10, 0)], "doc_id long, toxic int")
    frame = awkward_documents(spark)
    rows = toxicity.digest(frame, labels).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    rows = toxicity.digest(frame, labels.limit(0)).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.digest(empty_documents(spark), labels).count() == 0


def test_noisy_or():
    assert toxicity.noisy_or(np.array([])) == 0
    assert abs(toxicity.noisy_or(np.array([0.5, 0.5])) - 0.75) < 1e-12
    assert toxicity.noisy_or(np.array([1.0, 0.2])) > 1 - 1e-9
    assert abs(toxicity.noisy_or(np.array([0.5]), 0.5) - 0.75) < 1e-12


def test_scores_are_the_plain_noisy_or_of_sentences(spark):
    """Word by word and sentence by sentence, with the function that was trained."""
    documents, labels, _ = corpus(spark)
    model = toxicity.fit(documents, labels)
    dims = len(model.weights)
    got = {r.doc_key: r.score for r in toxicity.score(documents, model).collect()}
    for r in documents.limit(40).collect():
        clean = 1 - model.leak
        for sentence in r.text.split("."):
            words = set(sentence.encode().split())
            s = sum(float(model.weights[zlib.crc32(w[:n], n + 1 if n else 1) % dims]) if n else float(model.weights[zlib.crc32(w, 1) % dims]) for w in words for n in (0, 3, 4, 5, 6))
            if s > 0:
                clean *= math.exp(math.log1p(math.exp(model.bias)) - math.log1p(math.exp(s + model.bias)))
        assert abs(got[r.doc_id] - (1 - clean)) < 1e-5


def test_sample_of_labels(spark):
    documents, labels, truth = corpus(spark)
    long = documents.withColumn("text", toxicity.F.concat("text", toxicity.F.lit(" "), toxicity.F.repeat(toxicity.F.lit("plain words here. "), 20_000)))
    both = labels.union(labels.selectExpr("doc_id", "1 as toxic").filter("doc_id < 20"))  # two labels: toxic
    seen = []
    train = toxicity.train
    toxicity.train = lambda given, *rest: seen.append((given, rest)) or train(given, *rest)
    try:
        toxicity.fit(long.union(documents), both, per_class=30)
    finally:
        toxicity.train = train
    given, (_, _, prior) = seen[0]
    assert len(given.y) == 60 and given.y.sum() == 30
    assert abs(prior - (sum(truth.values()) + sum(1 - truth[i] for i in range(20))) / 400) < 1e-9
    assert given.per_document.max() > 20_000  # whole texts, also long ones
