"""Exact removal of word windows that a document with a smaller id already has, by super-k-mers.

Every document is cut into windows of ``window`` words. Consecutive windows that share a minimiser
(the smallest hash of ``minimiser`` words inside the window) form one super-k-mer, which travels as
one string to the bucket of its minimiser: equal windows have equal minimisers, so they meet there.
A bucket sorts its windows, compares equal hashes word by word, and finds the smallest document of
each window exactly.

Runs of words that a bounded sample shows to be frequent come last in the order of minimisers, so that
common phrases do not draw windows to one bucket; a window of nothing but such runs goes to the bucket of
its own hash instead, so that no frequent run has all its windows in one bucket.

Plan: documents are dealt into hash batches (one shuffle of the text, used by both passes). Pass one
sends each *distinct* super-k-mer of a batch once, with the smallest and largest document that has
it, so a passage or copy that a third of all rows share costs one row a batch. Buckets answer, to the
batch, with runs of windows whose smallest document comes before the entry's largest one. Pass two
regroups the batch with its answers and removes the covered words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_id, give_back, keep_share, mix64, packed, partitions, plain_words, texts, type_of

_PACKED = "bucket int, batch int, packed binary, entries binary"
_ANSWER = "batch int, runs binary"
_RUN = np.dtype([("entry", "<u4"), ("first", "<u4"), ("count", "<u4"), ("owner", "<i8")])
_ENTRY = np.dtype([("entry", "<u4"), ("least", "<i8"), ("most", "<i8")])
_SLOT_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random(256, 11)
_STRIDE = 1 << 11


def _powers(x: int, n: int) -> np.ndarray:
    """The first n powers of x, modulo 2**64."""
    steps = np.full(max(n, 1), x % (1 << 64), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, _STRIDE), _powers(_INVERSE, _STRIDE)


class _Hashes:
    """64-bit hashes of all substrings of a buffer, from one running sum over its bytes.

    Equal substrings have equal hashes wherever they stand; what has equal hashes is compared byte by
    byte where it matters.
    """

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        rows, rest = divmod(n, _STRIDE)
        # a power is one of few fine steps times one of few coarse ones
        coarse = _powers(pow(_BASE, _STRIDE, 1 << 64), rows + 1)
        self.down = _powers(pow(_INVERSE, _STRIDE, 1 << 64), rows + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = self.sums[1:]
        np.take(_BYTE, buffer, out=terms)
        square = terms[: n - rest].reshape(rows, _STRIDE)
        square *= _UP
        square *= coarse[:rows, None]
        terms[n - rest :] *= _UP[:rest] * coarse[rows]
        np.cumsum(terms, out=terms)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self.down[begin // _STRIDE] * _DOWN[begin % _STRIDE]
        return (self.sums[end] - self.sums[begin]) * down


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _word_runs(h: np.ndarray, m: int) -> np.ndarray:
    """One mixed hash for every m consecutive word hashes."""
    n = len(h)
    x = h.copy()
    for j in range(1, m):
        x[: n - j] = x[: n - j] * _MULTIPLIER + h[j:]
    return mix64(x[: n - m + 1])


def _frequent_runs(documents: DataFrame, total: int, m: int, sample: int, share: float) -> np.ndarray:
    """Hash slots of the runs of m words that make up over ``share`` of a bounded sample's runs.

    The sample is about ``sample`` of the ``total`` documents, of those with at most 16 KB of text. A minimiser is a function of the window alone whatever the slots are, so results do not hang on
    the sample; but with frequent runs put last, no common phrase draws a large part of all windows
    to its bucket.
    """
    some = documents.filter(keep_share(F.col("doc_key").cast("string"), sample / max(total, 1)) & (F.octet_length("text") <= 1 << 14))
    counts = np.zeros(1 << _SLOT_BITS, np.int64)
    for row in some.select("text").limit(2 * sample).toLocalIterator():
        batch = _Batch([0], [row.text.encode()], 1 << 30, m)
        if len(batch.hashes) >= m:
            runs = _word_runs(batch.hashes, m) >> np.uint64(64 - _SLOT_BITS)
            np.add.at(counts, runs, 1)
    return counts > np.maximum(8, share * counts.sum())


class _Batch:
    """The documents of one batch in a fixed order, and their super-k-mers."""

    def __init__(self, ids, raw, window: int, minimiser: int, frequent: np.ndarray | None = None):
        self.window, self.frequent = window, frequent
        rows = sorted(zip(ids, raw, range(len(ids))), key=lambda r: (r[0], r[1] is None, r[1] or b""))
        self.order = [r[2] for r in rows]
        self.ids = np.array([r[0] for r in rows], np.int64)
        counts, lines = np.zeros(len(rows), np.int64), []
        for i, r in enumerate(rows):
            if words := plain_words(r[1]):
                counts[i] = len(words)
                lines.append(b" ".join(words))
        del rows
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.joined = b" ".join(lines)
        del lines
        buffer = np.frombuffer(self.joined, np.uint8)
        ends = np.concatenate([np.flatnonzero(buffer == 32), [len(buffer)]])[: int(self.bounds[-1])]
        self.starts = np.concatenate([[0], ends + 1])  # one more than there are words
        self.codes = _Hashes(buffer)
        self.hashes = self.codes.of(self.starts[:-1], ends)
        self.kmers(self.hashes, counts, minimiser)
        self.codes = None

    def kmers(self, h: np.ndarray, counts: np.ndarray, m: int) -> None:
        """first, windows, least hash, document of every super-k-mer; entry numbers of equal strings."""
        k, n = self.window, len(h)
        self.first = np.zeros(0, np.int64)
        if n >= k:
            x = _word_runs(h, m)
            if self.frequent is not None:  # frequent runs come after all others
                x = (x >> np.uint64(1)) | (self.frequent[x >> np.uint64(64 - _SLOT_BITS)].astype(np.uint64) << np.uint64(63))
            least = _sliding_min(x, k - m + 1)
            if self.frequent is not None and len(only := np.flatnonzero(least >> np.uint64(63))):  # windows of frequent runs only
                own = self.codes.of(self.starts[only], self.starts[only + k] - 1)
                least[only] = mix64(own) | (np.uint64(1) << np.uint64(63))
            document = np.repeat(np.arange(len(counts)), counts)
            fits = document[: n - k + 1] == document[k - 1 :]
            at = np.flatnonzero(fits)
            if len(at):
                v, d = least[at], document[at]
                new = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
                cut = np.flatnonzero(new)
                self.first, self.least, self.document = at[cut], v[cut], d[cut]
                self.n_windows = np.diff(np.concatenate([cut, [len(at)]]))
        if len(self.first):
            begin, end = self.starts[self.first], self.starts[self.first + self.n_windows + k - 1] - 1
            seen: dict[bytes, int] = {}
            joined = self.joined
            self.entry = np.array([seen.setdefault(joined[a:b], len(seen)) for a, b in zip(begin.tolist(), end.tolist())], np.int64)
            self.strings = list(seen)
        else:
            self.least, self.document = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.n_windows, self.entry, self.strings = self.document, self.document, []

    def packed(self, batch: int, n_buckets: int) -> Iterator[dict]:
        """One row for each bucket: the distinct super-k-mers, and who has them first and last."""
        n = len(self.strings)
        if not n:
            return
        least, most = np.full(n, NULL_ID), np.full(n, -(1 << 63))
        np.minimum.at(least, self.entry, self.ids[self.document])
        np.maximum.at(most, self.entry, self.ids[self.document])
        bucket = np.zeros(n, np.int64)
        bucket[self.entry] = (mix64(self.least) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            entries = np.zeros(len(part), _ENTRY)
            entries["entry"], entries["least"], entries["most"] = part, least[part], most[part]
            yield {
                "bucket": int(bucket[part[0]]), "batch": batch,
                "packed": _zip(b"\n".join([self.strings[i] for i in part.tolist()])), "entries": _zip(entries.tobytes()),
            }

    def removed(self, runs: np.ndarray) -> np.ndarray:
        """For each word of the batch, whether a window over it is owned by a smaller document."""
        marks = np.zeros(len(self.starts), np.int64)
        if len(runs) and len(self.first):
            runs = runs[np.argsort(runs["entry"], kind="stable")]
            low = np.searchsorted(runs["entry"], self.entry)
            many = np.searchsorted(runs["entry"], self.entry, side="right") - low
            at = np.repeat(np.arange(len(self.entry)), many)
            run = runs[np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
            later = run["owner"] < self.ids[self.document[at]]
            begin = self.first[at[later]] + run["first"][later]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + run["count"][later] + self.window - 1, -1)
        return np.cumsum(marks)[: int(self.bounds[-1])] > 0


class _Packed:
    """The distinct super-k-mers that one batch sent to a bucket, and their windows."""

    def __init__(self, batch: int, packed: bytes, entries: bytes, window: int):
        self.batch, self.window, self.text = batch, window, _unzip(packed)
        self.entries = np.frombuffer(_unzip(entries), _ENTRY)

    def places(self):
        """Entry, number inside the entry, first and last byte of every window."""
        buffer = np.frombuffer(self.text, np.uint8)
        ends = np.concatenate([np.flatnonzero((buffer == 32) | (buffer == 10)), [len(buffer)]]).astype(np.int32)
        begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int32)
        last = np.concatenate([np.flatnonzero(buffer[ends[:-1]] == 10), [len(ends) - 1]]).astype(np.int32)  # last word of each entry
        n_words = np.diff(last, prepend=-1)
        n_windows = n_words - self.window + 1
        entry = np.repeat(np.arange(len(last), dtype=np.int32), n_windows)
        at = np.arange(len(entry), dtype=np.int32) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows).astype(np.int32)
        word = (last + 1 - n_words)[entry] + at
        return entry, at, begins[word], ends[word + self.window - 1]

    def codes(self) -> np.ndarray:
        _, _, begin, end = self.places()
        return _Hashes(np.frombuffer(self.text, np.uint8)).of(begin, end)


def _repeated(codes: np.ndarray) -> np.ndarray:
    """Which codes are there more than once."""
    order = np.argsort(codes)
    same = codes[order[1:]] == codes[order[:-1]]
    out = np.zeros(len(codes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _owners(rows: list[tuple[int, bytes, bytes]], window: int) -> Iterator[dict]:
    """Windows of one bucket, sorted and compared; for each batch the runs that have an earlier owner.

    Codes of all windows are held first (eight bytes each); places only of those that matter.
    """
    parts = [_Packed(*row, window) for row in rows]
    codes = [p.codes() for p in parts]
    matters = np.split(_repeated(np.concatenate(codes)), np.cumsum([len(c) for c in codes])[:-1])
    of, offset, code, begin, end, part = [], [], [], [], [], []
    for number, (p, c, some) in enumerate(zip(parts, codes, matters)):
        entry, at, first, last = p.places()
        # a window counts if other entries have it too, or several documents of its own batch
        some = some | (p.entries["least"] < p.entries["most"])[entry]
        for whole, x in ((of, entry), (offset, at), (code, c), (begin, first), (end, last), (part, np.full(len(entry), number, np.int32))):
            whole.append(x[some])
    del codes, matters
    of, offset, code, begin, end, part = (np.concatenate(x) for x in (of, offset, code, begin, end, part))
    if not len(of):
        return
    starts = np.cumsum([0] + [len(p.entries) for p in parts[:-1]])
    of = of + starts[part]
    entries = np.concatenate([p.entries for p in parts])
    batches = np.repeat([p.batch for p in parts], [len(p.entries) for p in parts])
    order = np.argsort(code, kind="stable")
    new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    word_lists = lambda: (parts[n].text[a:b] for n, a, b in zip(part[order].tolist(), begin[order].tolist(), end[order].tolist()))
    # equal hashes are compared word for word
    before, collide = None, False
    for fresh, words in zip(new.tolist(), word_lists()):
        if not fresh and words != before:
            collide = True
            break
        before = words
    if collide:
        windows = list(word_lists())
        by_words = sorted(range(len(order)), key=windows.__getitem__)
        order = order[by_words]
        new = np.array([True] + [windows[i] != windows[j] for i, j in zip(by_words, by_words[1:])])
    owner = np.minimum.reduceat(entries["least"][of[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    late = owner < entries["most"][of[order]]
    w, owner = order[late], owner[late]
    back = np.argsort(w, kind="stable")
    w, owner = w[back], owner[back]
    if not len(w):
        return
    o, e = offset[w], of[w]
    begins = np.concatenate([[True], (e[1:] != e[:-1]) | (o[1:] != o[:-1] + 1) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(begins)
    runs = np.zeros(len(at), _RUN)
    runs["entry"], runs["first"], runs["owner"] = entries["entry"][e[at]], o[at], owner[at]
    runs["count"] = np.diff(np.concatenate([at, [len(w)]]))
    to = batches[e[at]]
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        yield {"batch": int(to[part[0]]), "runs": _zip(runs[part].tobytes())}


def _table(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=schema)


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("packed", pa.binary()), ("entries", pa.binary())])
_ANSWER_ARROW = pa.schema([("batch", pa.int32()), ("runs", pa.binary())])


def remove_repeats(
    documents: DataFrame, window: int = 13, minimiser: int = 2, batches_per_partition: int = 4, buckets_per_partition: int = 1,
    batch_bytes: int = 1 << 22, bucket_bytes: int = 1 << 24, keep_text: bool = True, carry: bool = False, sample: int = 2000,
    frequent_share: float = 5e-5,
) -> DataFrame:
    """``doc_key, n_words, n_removed, kept, kept_sha256`` for every row; kept: the words left, joined by
    one space, or the text as it came where none went; with carry, also ``row``, a struct of all columns but text.

    Words are runs of bytes other than ASCII white space. A word goes if any window over it also
    starts in a document with a smaller id. Null texts have no words; texts shorter than a window
    lose nothing; rows with one id (repeated rows) never remove each other's words; a null id counts
    as larger than all others. An empty table gives an empty result. Only doc_id and text are read.

    A batch has about ``batch_bytes`` of text and a bucket the windows of about ``bucket_bytes``, whatever
    the number of partitions is; there are more of both where partitions would have less work otherwise.
    """
    if not 0 < minimiser <= window:
        raise ValueError("the minimiser has to fit into the window")
    spark = documents.sparkSession
    n = partitions(spark)
    rows = packed(documents)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # as many for each partition, so that none has twice the work of another
    n_batches = n * max(batches_per_partition, -(-size.bytes // (n * batch_bytes)))
    n_buckets = n * max(buckets_per_partition, -(-size.bytes // (n * bucket_bytes)))
    if not carry:
        rows = rows.withColumn("row", F.lit(None).cast("boolean"))
    kind = type_of(rows, "row")
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_key"), F.lit(n_batches)).cast("int"))
    # by number, so that each partition has as many batches and buckets as any other
    dealt = dealt.repartitionById(n, "batch")

    frequent = spark.sparkContext.broadcast(_frequent_runs(rows, size.n, minimiser, sample, frequent_share))  # one byte a slot: 1 MB

    def pack(table: pa.Table) -> pa.Table:
        batch = _Batch(table["doc_key"].to_pylist(), texts(table["text"]), window, minimiser, frequent.value)
        out = _table(batch.packed(table["batch"][0].as_py(), n_buckets), _PACKED_ARROW)
        del batch
        give_back()
        return out

    def answer(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("batch", "packed", "entries"))))
        out = _table(_owners(rows, window), _ANSWER_ARROW)
        del rows
        give_back()
        return out

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = _Batch(left["doc_key"].to_pylist(), texts(left["text"]), window, minimiser, frequent.value)
        runs = [np.frombuffer(_unzip(r), _RUN) for r in right["runs"].to_pylist()]
        gone = batch.removed(np.concatenate(runs) if runs else np.zeros(0, _RUN))
        n_removed, kept, sha = [], [], []
        raw = texts(left["text"])
        batch.joined, batch.strings, batch.hashes, batch.starts = b"", [], None, None
        give_back()
        for a, b, at in zip(batch.bounds.tolist(), batch.bounds[1:].tolist(), batch.order):
            out, words = gone[a:b], plain_words(raw[at])
            n_removed.append(int(out.sum()))
            text = b" ".join([w for w, x in zip(words, out.tolist()) if not x] if n_removed[-1] else words)
            kept.append(text if n_removed[-1] else raw[at])
            sha.append(hashlib.sha256(text).hexdigest())
        return pa.table({
            "doc_key": batch.ids, "row": left["row"].take(pa.array(batch.order, pa.int64())), "n_words": np.diff(batch.bounds),
            "n_removed": np.array(n_removed, np.int64), "kept": pa.array(kept, pa.binary()).cast(pa.string()) if keep_text else pa.nulls(len(kept), pa.string()),
            "kept_sha256": sha,
        })

    packed_rows = dealt.groupBy("batch").applyInArrow(pack, _PACKED).repartitionById(n, "bucket")
    answers = packed_rows.groupBy("bucket").applyInArrow(answer, _ANSWER).repartitionById(n, "batch")
    schema = f"doc_key long, row {kind}, n_words long, n_removed long, kept string, kept_sha256 string"
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(apply, schema)


def digest(documents: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = remove_repeats(documents, keep_text=False, **parameters)
    return out.select(as_id("doc_key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM w, UNNEST(range(1, len(ws) - 11)) AS u(i)),
    o AS (SELECT k, min(doc_id) AS owner FROM p GROUP BY k),
    g AS (SELECT DISTINCT doc_id, i + j.j AS pos FROM p JOIN o USING (k), range(0, 13) AS j(j) WHERE owner < doc_id),
    x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM x ANTI JOIN g USING (doc_id, pos) GROUP BY 1),
    gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
