import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import substring_dedup
from tests.llm.frames import awkward_documents, empty_documents, plain_words

LAST = 1 << 63


def brute(rows, window=13):
    own = {}
    for i, t in rows:
        w, key = plain_words(t), LAST if i is None else i
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            own[k] = min(own.get(k, LAST), key)
    out = []
    for i, t in rows:
        w, key = plain_words(t), LAST if i is None else i
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if own[tuple(w[p : p + window])] < key:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest() if sum(gone) else None))
    return out


def check(frame, window=13):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = substring_dedup.digest(frame, window=window).collect()
    want = Counter((i, n, g, s or hashlib.sha256(" ".join(plain_words(t)).encode()).hexdigest()) for (i, n, g, s), (_, t) in zip(brute(rows, window), rows))
    assert Counter(tuple(r[:4]) for r in got) == want


def test_awkward_rows(spark):
    check(awkward_documents(spark))


def test_narrow_windows(spark):
    check(awkward_documents(spark), window=3)


def test_empty(spark):
    assert substring_dedup.digest(empty_documents(spark)).count() == 0


def test_columns_are_carried(spark):
    rows = substring_dedup.remove_repeats(awkward_documents(spark), carry=True).select("doc_key", "row.doc_id", "row.batch", "kept").collect()
    assert len(rows) == awkward_documents(spark).count()
    assert all(r.doc_id in (None, r.doc_key) and r.batch == 2 for r in rows)


def test_hash_collisions_are_told_apart(monkeypatch):
    """With one hash for all substrings every window collides; the words decide."""
    monkeypatch.setattr(substring_dedup._Hashes, "of", lambda self, begin, end: np.ones(len(begin), np.uint64))
    batch = substring_dedup._Batch([1, 2, 3], [b"a b c d", b"x a b c", b"p q r s"], 3, 1)
    rows = [(p["batch"], p["packed"], p["entries"]) for p in batch.packed(0, 1)]
    runs = [np.frombuffer(substring_dedup._unzip(x["runs"]), substring_dedup._RUN) for x in substring_dedup._owners(rows, 3)]
    assert batch.removed(np.concatenate(runs)).tolist() == [False] * 5 + [True] * 3 + [False] * 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 4), st.sampled_from([None, 0.0, 0.5, 1.0]))
def test_any_small_corpus(documents, window, minimiser, frequent):
    slots = None if frequent is None else np.random.default_rng(1).random(1 << 20) < frequent
    raw = [" ".join(d).encode() for d in documents]
    ids = list(range(len(raw)))
    batch = substring_dedup._Batch(ids, raw, window, min(minimiser, window), slots)
    buckets = {}
    for p in batch.packed(0, 3):
        buckets.setdefault(p["bucket"], []).append((0, p["packed"], p["entries"]))
    runs = [np.frombuffer(substring_dedup._unzip(x["runs"]), substring_dedup._RUN) for rows in buckets.values() for x in substring_dedup._owners(rows, window)]
    gone = batch.removed(np.concatenate(runs) if runs else np.zeros(0, substring_dedup._RUN))
    assert [int(gone[a:b].sum()) for a, b in zip(batch.bounds, batch.bounds[1:])] == [g for _, _, g, _ in brute(list(zip(ids, [r.decode() for r in raw])), window)]


def test_small_batches_and_buckets(spark):
    frame = awkward_documents(spark)
    one = Counter(map(tuple, substring_dedup.digest(frame).collect()))
    assert Counter(map(tuple, substring_dedup.digest(frame, batch_bytes=2000, bucket_bytes=2000).collect())) == one


def test_windows_of_a_frequent_phrase_spread(spark):
    """Every pair of words is frequent: all windows would go to the buckets of a few pairs."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["as", "is", "it"], 60)) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequent = substring_dedup._frequent_runs(frame.withColumnRenamed("doc_id", "doc_key"), 200, 2, 2000, 5e-5)
    share = []
    for slots in (None, frequent):
        batch = substring_dedup._Batch(list(range(200)), [t.encode() for t in texts], 13, 2, slots)
        sizes = [len(np.frombuffer(substring_dedup._unzip(p["entries"]), substring_dedup._ENTRY)) for p in batch.packed(0, 64)]
        share.append(max(sizes) / sum(sizes))
    assert share[0] > 0.15 and share[1] < 0.03
    check(frame)
