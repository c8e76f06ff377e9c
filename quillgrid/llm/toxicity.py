"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's evidence s is the sum of the weights of its words (the word and its beginnings, hashed). Its
probability is p = 1 - exp(-rate), with rate = softplus(s + bias) - softplus(bias), and 0 for s <= 0: a
sentence without evidence adds nothing, however many a text has. A document is toxic unless none of its
sentences is, nor the leak that stands for all other causes: P = 1 - (1 - leak) prod(1 - p). This P is what is
trained and what scores. Only documents have labels; the gradient through the noisy-or finds the sentences
that explain them, and these are reported.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, Numbers, as_id, in_slices, key_id, texts
from .language_id import held_out

#: Ends of sentences become a line feed, all else as in FOLD; positions stay.
_ENDS = bytes(10 if b in b".!?\n" else f for b, f in enumerate(FOLD))
_PREFIXES = (3, 4, 5, 6)
_CHUNK = 1 << 18


def _sentences(text: bytes | None) -> list[tuple[int, int, list[bytes]]]:
    """(begin, end, distinct words) of every sentence with a word, as byte offsets into the text."""
    out, at = [], 0
    for part in text.translate(_ENDS).split(b"\n") if text else ():
        if words := part.split():
            out.append((at, at + len(part), list(dict.fromkeys(words))))
        at += len(part) + 1
    return out


def _features(words: list[bytes], dims: int) -> np.ndarray:
    """words x features: the whole word and its beginnings."""
    crc = zlib.crc32
    out = np.empty((len(words), 1 + len(_PREFIXES)), np.int64)
    for i, w in enumerate(words):
        out[i] = (crc(w, 1), *[crc(w[:n], n + 1) for n in _PREFIXES])
    return out % dims


def _rates(s: np.ndarray, bias: float) -> np.ndarray:
    return np.where(s > 0, np.logaddexp(0, np.minimum(s, 60) + bias) - np.logaddexp(0, bias), 0.0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float  # a probability

    def sentences(self, documents: list[list[list[bytes]]]) -> list[np.ndarray]:
        """The probability of each sentence of each document."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(documents):
            upto, n = at, 0
            while upto < len(documents) and (upto == at or n <= _CHUNK):
                n += sum(map(len, documents[upto]))
                upto += 1
            known = Numbers()
            sizes = np.array([len(s) for d in documents[at:upto] for s in d], np.int64)
            numbers = known.of([w for d in documents[at:upto] for s in d for w in s])
            p = np.zeros(len(sizes))
            if len(numbers):
                value = self.weights[_features(list(known), len(self.weights))].sum(1, dtype=np.float64)
                p = -np.expm1(-_rates(np.add.reduceat(value[numbers], np.cumsum(sizes) - sizes), self.bias))
            cuts = np.cumsum([len(d) for d in documents[at:upto]])[:-1]
            out += np.split(p, cuts)
            at = upto
        return out


def noisy_or(p: np.ndarray, leak: float = 0.0) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum() + np.log1p(-leak)))


@dataclass
class Examples:
    """Documents with a sentence: numbers of the distinct words of each sentence, sentence by sentence."""

    words: list[bytes]  # by number
    numbers: np.ndarray
    sizes: np.ndarray  # words of each sentence
    per_document: np.ndarray  # sentences of each document
    y: np.ndarray


def examples(found: list[tuple[bytes | None, int]]) -> Examples:
    known, numbers, sizes, per_document, y = Numbers(), [], [], [], []
    for text, toxic in found:
        if cut := _sentences(text):
            numbers += [known.of(s[2]).astype(np.int32) for s in cut]
            sizes += [len(s[2]) for s in cut]
            per_document.append(len(cut))
            y.append(toxic)
    joined = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    return Examples(list(known), joined, np.array(sizes, np.int64), np.array(per_document, np.int64), np.array(y, float))


def train(given: Examples, dims: int, rounds: int, prior: float, sparse: float = 0.06) -> Model:
    """Gradient steps through the noisy-or, with soft thresholding: most words keep no weight at all.

    prior: the share of toxic documents; sparse: the threshold as a multiple of a chance gradient.
    """
    weights, bias = np.zeros(dims), -6.0
    y, numbers = given.y, given.numbers
    if not 0 < y.sum() < len(y):
        return Model(weights.astype(np.float32), bias, 0.0)
    level = float(np.log(-np.log1p(-prior)))  # the leak's rate is exp(level): first it stands for all toxic documents
    sparse = sparse * prior / np.sqrt(y.sum())
    features = _features(given.words, dims)
    sentence = np.repeat(np.arange(len(given.sizes), dtype=np.int32), given.sizes)
    document = np.repeat(np.arange(len(y), dtype=np.int32), given.per_document)
    # features of fewer than three documents have no say
    pairs = np.unique(document[sentence].astype(np.int64) * len(given.words) + numbers)
    df = np.bincount(features[pairs % len(given.words)].ravel(), minlength=dims)
    usable = df >= 3
    first_word, first_sentence = np.cumsum(given.sizes) - given.sizes, np.cumsum(given.per_document) - given.per_document
    balance = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    m, v, other, square = np.zeros(dims), np.zeros(dims), np.zeros(2), np.zeros(2)
    for t in range(1, rounds + 1):
        s = np.add.reduceat(weights[features].sum(1)[numbers], first_word)
        total = np.exp(level) + np.add.reduceat(_rates(s, bias), first_sentence)
        none = np.exp(-total)
        pull = (np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * balance)[document]
        # a sentence without evidence has no slope of its own: it is held at nothing, or raised
        slope = logistic(s + bias) * pull * ((s >= 0) | (pull < 0))
        by_word = np.bincount(numbers, slope[sentence], len(given.words))
        g = np.bincount(features.ravel(), np.repeat(by_word, features.shape[1]), dims) * usable
        g = np.sign(g) * np.maximum(np.abs(g) - sparse * (weights == 0), 0) + sparse * np.sign(weights)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        after = weights - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        weights = np.where(weights * after < 0, 0.0, after)
        both = np.array([((logistic(s + bias) - logistic(bias)) * pull * (s > 0)).sum(), np.exp(level) * (pull / given.per_document[document]).sum()])
        other, square = 0.9 * other + 0.1 * both, 0.99 * square + 0.01 * both * both
        step = 0.05 * (other / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        bias, level = min(bias - step[0], -1.0), max(level - step[1], -12.0)
    return Model(weights.astype(np.float32), float(bias), float(-np.expm1(-np.exp(level))))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 2000, dims: int = 1 << 18, rounds: int = 160) -> Model:
    """Fit on documents joined to labels (doc_id, toxic): of each class the first ``per_class`` ids in a seeded hash
    order, with whole texts. That bound is the classifier's sample, and keeps the driver's memory to it.

    An id with both labels counts as toxic; of several texts with one id, the one with the smallest hash is taken.
    Without labels of both classes there is no evidence and no leak: all scores are 0.
    """
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30))
    # a low enough place for four times as many ids leaves no class to be sorted whole
    reach = F.when(F.col("toxic") == 1, F.lit(4 * per_class / max(1, counts.get(1, 0)))).otherwise(F.lit(4 * per_class / max(1, counts.get(0, 0))))
    few = labels.filter(place < reach * F.lit(float(1 << 30)))
    chosen = few.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy(place, "doc_id"))).filter(F.col("n") <= per_class).drop("n")  # at most 2 * per_class
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toArrow().sort_by("doc_id")
    given = examples(list(zip(texts(sample["text"]), sample["toxic"].to_pylist())))
    return train(given, dims, rounds, counts.get(1, 0) / max(1, sum(counts.values())))


def score(documents: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """doc_key, score, and the offending sentences (begin, end in the text's UTF-8, p) of every row.

    Null, empty and wordless texts have no sentence: they score the leak, none offending. Rows are judged one by one.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        model = sent.value
        for batch in batches:
            raw, ps, found = texts(batch["text"]), [], []
            for begin, end in in_slices(raw):
                cut = [_sentences(t) for t in raw[begin:end]]
                for d, p in zip(cut, model.sentences([[s[2] for s in d] for d in cut])):
                    ps.append(noisy_or(p, model.leak))
                    found.append([{"begin": d[i][0], "end": d[i][1], "p": float(p[i])} for i in np.flatnonzero(p >= offending)])
            yield pa.RecordBatch.from_arrays([batch["doc_key"], pa.array(ps, pa.float64()), pa.array(found, spans)], ["doc_key", "score", "offending"])

    rows = documents.select(key_id().alias("doc_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_key long, score double, offending array<struct<begin: long, end: long, p: double>>")


def digest(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labels whose id's crc32 modulo 4 is not 2."""
    model = fit(documents, labels.filter(~held_out(4, 2)), **parameters)
    out = score(documents, model).withColumn("doc_id", as_id("doc_key"))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
