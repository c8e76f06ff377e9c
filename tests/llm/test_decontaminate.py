import hashlib
from collections import Counter

import pytest

from quillgrid.llm import decontaminate
from tests.llm.frames import awkward_documents, empty_documents, folded_words


def brute(rows, items, window=13):
    patterns = {}
    for i, t in items:
        w = folded_words(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            patterns.setdefault(tuple(w[p : p + k]), set()).add("null" if i is None else str(i))
    out = Counter()
    for d, t in rows:
        w, found = folded_words(t), set()
        hit = [False] * len(w)
        for k in {len(p) for p in patterns}:
            for p in range(len(w) - k + 1):
                if names := patterns.get(tuple(w[p : p + k])):
                    found |= names
                    hit[p : p + k] = [True] * k
        out[(d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))] += 1
    return out


@pytest.fixture
def items(spark):
    texts = [r.text for r in awkward_documents(spark).collect()]
    rows = [(1, texts[10]), (2, "one"), (3, None), (4, ""), (None, texts[15]), (2, "Zwei wörter"), (5, (texts[7] or "").upper()), (5, texts[7]), (10, "ONE"), (11, "...")]
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_key int")


def test_awkward_rows(spark, items):
    frame = awkward_documents(spark)
    want = brute([(r.doc_id, r.text) for r in frame.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter(map(tuple, decontaminate.digest(frame, items).collect())) == want
    # many small automata find what one finds
    assert Counter(map(tuple, decontaminate.digest(frame, items, slice_nodes=2000).collect())) == want


def test_empty_tables(spark, items):
    assert decontaminate.digest(empty_documents(spark), items).count() == 0
    none = decontaminate.digest(awkward_documents(spark), items.limit(0))
    assert none.filter("n_hit > 0 or contaminated").count() == 0 and none.count() == awkward_documents(spark).count()


def test_byte_spans_point_into_the_text(spark, items):
    for r in decontaminate.find(awkward_documents(spark), items, carry=True).collect():
        words = folded_words(r.text)
        raw = (r.text or "").encode()
        assert [folded_words(raw[a:b].decode()) for a, b in r.byte_spans] == [words[a:b] for a, b in r.spans]


def test_a_worker_holds_bounded_nodes():
    """At the bound of a slice: words that differ, so hardly a window shares a node with another."""
    words = [f"w{i * 7919 % 100003}" for i in range((1 << 22) // 13 // 7)]
    text = " ".join(words).encode()
    assert 0.9 * (1 << 22) < 13 * len(text) <= 1 << 22
    stats = decontaminate.build([("1", text)], 13).get_stats()
    assert stats["nodes_count"] <= 1 << 22 and stats["total_size"] < 200e6
