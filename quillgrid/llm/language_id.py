"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier over hashed character n-grams predicts each bit.
Decoding sums every bit's logistic loss against each codeword and takes the language with the least
loss; a small gap to the second flags the text as ambiguous. Features add up over the words of a
text, so a batch scores its distinct words once and sums their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, Numbers, as_id, give_back, in_slices, packed, texts, type_of

_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 18
#: One odd multiplier for each n-gram length.
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _words(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(FOLD).split() if text else []


def _has_letter(text: bytes | None) -> bool:
    return bool(text) and _LETTER.search(text.decode("utf-8", "replace")) is not None


def _grams(words: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of bytes, word by word with a space on either side, and how many each word has."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths + 1) - lengths - 1  # the space before
    counts = 3 * lengths + 1  # so many unigrams, and with both spaces one more bigram, as many trigrams
    out = np.empty(int(counts.sum()), np.int64)
    to = np.cumsum(counts) - counts
    code = np.zeros(len(raw), np.uint32)
    for size in (1, 2, 3):
        n = len(raw) - size + 1
        code = code[:n] * np.uint32(257) + raw[size - 1 :]
        hashed = (((code ^ np.uint32(size * 7919)) * np.uint32(_ODD[size - 1])) >> np.uint32(7)).astype(np.int64) % dims
        many = lengths + 1 if size == 2 else lengths
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(to, many) + inside] = hashed[np.repeat(begins + (size == 1), many) + inside]
        to = to + many
    return out, counts


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """n rows of +1 and -1 with large least distance: the best of seeded draws; no bit is constant."""
    bits = max(7, int(np.ceil(8 * np.log2(max(n, 2)))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(max(8, min(400, 40_000_000 // (n * n)))):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits)).astype(np.int64)
        flat = np.abs(code.sum(0)) == n
        code[0, flat] *= -1
        apart = (bits - (code.astype(np.float32) @ code.T.astype(np.float32)).astype(np.int64)) // 2 + bits * np.eye(n, dtype=np.int64)
        if apart.min() > far:
            best, far = code, apart.min()
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray

    def margins(self, documents: list[list[bytes]]) -> np.ndarray:
        """Each bit's score of each document."""
        out = np.zeros((len(documents), self.code.shape[1]), np.float32)
        at = 0
        while at < len(documents):
            upto, n = at, 0
            while upto < len(documents) and (upto == at or n + len(documents[upto]) <= _CHUNK):
                n += len(documents[upto])
                upto += 1
            part = documents[at:upto]
            known = Numbers()
            numbers = known.of([w for d in part for w in d])
            if len(numbers):
                grams, counts = _grams(list(known), len(self.weights))
                rows = np.add.reduceat(self.weights[grams], np.cumsum(counts) - counts, axis=0)
                sizes = np.array([len(d) for d in part])
                full = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[full]
                n_grams = np.add.reduceat(counts[numbers], begin)
                for a in range(0, len(full), 4096):  # bounded memory
                    b = min(len(full), a + 4096)
                    lo, hi = begin[a], begin[b] if b < len(full) else len(numbers)
                    sums = np.add.reduceat(rows[numbers[lo:hi]], begin[a:b] - lo, axis=0)
                    out[at + full[a:b]] = sums / n_grams[a:b, None]
            at = upto
        return out + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and the gap between the two least losses by bit."""
        up, down = (self.code > 0).astype(np.float32), (self.code < 0).astype(np.float32)
        loss = (np.logaddexp(0, -margins) @ up.T + np.logaddexp(0, margins) @ down.T).astype(np.float64)
        best = loss.argmin(1)
        least = loss[np.arange(len(loss)), best]
        share = 1 / np.exp(least[:, None] - loss).sum(1)
        if loss.shape[1] == 1:
            return best, share, np.full(len(loss), np.inf)
        loss[np.arange(len(loss)), best] = np.inf
        return best, share, (loss.min(1) - least) / self.code.shape[1]


def _chosen(rows: DataFrame, per_language: int, max_rows: int, max_languages: int) -> DataFrame:
    """The distinct (lang, text) learnt from, with their place ``order`` in a seeded hash order: the first ones of each language."""
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("texts"))
    top = sizes.orderBy(F.desc(F.least("texts", F.lit(per_language))), "lang").limit(max_languages).collect()
    each = max(1, min(per_language, max_rows // max(1, len(top))))
    # places low enough for four times as many texts and more, so no language is sorted whole
    cuts = [(r.lang, (4 * each + 32) / max(1, r.texts) * 2.0**64 - 2.0**63) for r in top]
    cuts = F.broadcast(rows.sparkSession.createDataFrame(cuts, "lang string, cut double"))
    low = rows.select("lang", "order").join(cuts, "lang").filter(F.col("order").cast("double") < F.col("cut")).select("lang", "order").distinct()
    first = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("n") <= each)
    last = first.groupBy("lang").agg(F.max("order").alias("last"))  # at most max_languages rows
    return rows.join(F.broadcast(last), "lang").filter("order <= last").dropDuplicates(["lang", "order"])


def _examples(rows: DataFrame, dims: int) -> DataFrame:
    """lang, order, piece, slots, shares: the n-grams of each text, and of a short piece from its middle, so that
    short texts are not judged by the bias. Made where the texts are: only these sparse rows come to the driver."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, order, text in zip(batch["lang"].to_pylist(), batch["order"].to_pylist(), texts(batch["text"])):
                words = _words(text)
                for piece, part in enumerate((words, words[len(words) // 2 :][:6])):
                    if part:
                        slots, counts = np.unique(_grams(part, dims)[0], return_counts=True)
                        out.append((lang, order, piece, slots.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
            columns = [*zip(*out)] if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "order", "piece", "slots", "shares"])

    return rows.select("lang", "order", "text").mapInArrow(run, "lang string, order long, piece int, slots array<int>, shares array<float>")


def fit(
    rows: DataFrame, per_language: int = 500, dims: int = 4096, steps: int = 240, max_rows: int = 16_000, max_languages: int = 1000,
) -> Model | None:
    """Fit on rows (text, lang) of labelled documents; None without any.

    Learnt from are the first ``per_language`` texts of each language in a seeded hash order of texts, whole
    whatever their length; fewer of each where all would be over ``max_rows``, and no more than ``max_languages``
    languages: those with most texts, counted (about) up to ``per_language``, of equal ones the first by name. These bounds are the classifier's sample; what they bound is the driver's
    memory. A text that is there several times under a language counts once, under two languages for both.
    """
    rows = rows.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("order", F.xxhash64("text", F.lit("fit")))
    found = _examples(_chosen(rows, per_language, max_rows, max_languages), dims).toArrow()
    found = found.sort_by([("lang", "ascending"), ("order", "ascending"), ("piece", "ascending")]).combine_chunks()
    if not len(found):
        return None
    languages = sorted(set(found["lang"].to_pylist()))
    of = {lang: i for i, lang in enumerate(languages)}
    y = np.array([of[x] for x in found["lang"].to_pylist()], np.int64)
    slots, shares = (found[c].combine_chunks().flatten().to_numpy() for c in ("slots", "shares"))
    ends = np.cumsum(found["slots"].combine_chunks().value_lengths().to_numpy())
    mean = np.bincount(slots, shares, dims) / len(y)
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)
    return Model(languages, *_train(slots, shares * scale[slots], ends, y, codewords(len(languages)), scale, steps))


def _train(slots, values, ends, y, code, scale, steps: int, batch: int = 512):
    """Code, weights and bias of logistic bits, by steps over small batches; no more than a batch is dense at a time."""
    n, dims = len(y), len(scale)
    begins = np.concatenate([[0], ends[:-1]])
    weights, bias = np.zeros((dims, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    balance = (1 / np.bincount(y, minlength=len(code)).clip(1))[y].astype(np.float32)
    balance *= n / balance.sum()
    m, v, rng, turn = np.zeros_like(weights), np.zeros_like(weights), np.random.default_rng(3), np.zeros(0, np.int64)
    for t in range(1, max(steps, 4 * -(-n // batch)) + 1):
        if not len(turn):
            turn = rng.permutation(n)
        rows, turn = turn[:batch], turn[batch:]
        many = ends[rows] - begins[rows]
        at = np.repeat(begins[rows], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        x = np.zeros((len(rows), dims), np.float32)
        x[np.repeat(np.arange(len(rows)), many), slots[at]] = values[at]
        target = code[y[rows]]
        slope = -target / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30))) * (balance[rows, None] / len(rows))
        g = x.T @ slope + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= 0.5 * slope.sum(0)
    return code, (weights * scale[:, None]).astype(np.float32), bias


def predict(documents: DataFrame, model: Model | None, ambiguous_below: float = 0.05, carry: bool = False) -> DataFrame:
    """doc_key, lang_pred, score, ambiguous of every row, from the text alone; with carry, also text, row and
    lettered (whether the text has a letter).

    Null texts and texts without a letter are ``und`` with score 0; so is everything where no labelled
    row was given. With one language all other texts have it, with score 1. Rows are judged one by one.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            raw = texts(batch["text"])
            names, scores, vague = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
            for begin, end in in_slices(raw):
                at = [i for i in range(begin, end) if model is not None and _has_letter(raw[i])]
                if at:
                    best, share, gap = model.decode(model.margins([_words(raw[i]) for i in at]))
                    for i, b in zip(at, best.tolist()):
                        names[i] = model.languages[b]
                    scores[at], vague[at] = share, gap < ambiguous_below
            found = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores), "ambiguous": pa.array(vague)}
            if carry:
                found["lettered"] = pa.array([_has_letter(t) for t in raw], pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in carried} | found)
            give_back()

    rows = packed(documents)
    if not carry:
        rows = rows.select("doc_key", "text")
    carried = [c for c in rows.columns if carry or c == "doc_key"]
    schema = ", ".join(f"{c} {type_of(rows, c)}" for c in carried)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean" + (", lettered boolean" if carry else ""))


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def digest(documents: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt where the id's crc32 modulo 3 is not 1."""
    model = fit(documents.filter(~held_out(3, 1)), **parameters)
    out = predict(documents, model).withColumn("doc_id", as_id("doc_key"))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")
