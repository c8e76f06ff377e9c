import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import simhash
from tests.llm.frames import awkward_documents, empty_documents, lower, plain_words

LAST = (1 << 63) - 1


def fingerprint(text):
    w = plain_words(lower(text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), LAST), LAST if doc is None else doc)
    return Counter((d, f"{p:016x}", None if least[root(i)] == LAST else least[root(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_awkward_rows(spark):
    frame = awkward_documents(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert Counter(map(tuple, simhash.near_duplicates(frame).collect())) == brute(rows)


def test_one_of_each_component_stays(spark):
    """The very rows, as a multiset: of each component the smallest id, of its texts the one with the smallest MD5."""
    frame = awkward_documents(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    prints, groups = [fingerprint(t) for _, t in rows], []
    for i, p in enumerate(prints):
        near = [g for g in groups if any((p ^ prints[j]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in near] + [[i, *(j for g in near for j in g)]]
    mark = lambda t: b"" if t is None else hashlib.md5(t.encode()).digest()
    want = [min((LAST if rows[i][0] is None else rows[i][0], mark(rows[i][1])) for i in g) for g in groups]
    assert Counter((LAST if r.doc_id is None else r.doc_id, mark(r.text)) for r in kept.collect()) == Counter(want)


def test_empty(spark):
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    assert simhash.keep_one(empty_documents(spark)).count() == 0


def test_both_shard_tables_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    codes = {0, 1, 3, 7, 0xFFFFFFFFFFFFFFFF}
    for c in rng.integers(0, 1 << 63, 60).tolist():
        codes |= {c, c ^ 1, c ^ (0b11111 << 40), c ^ (1 << 63) ^ 1 ^ (1 << 20) ^ (1 << 33)}
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, 0) for c in codes], "fp long, least long")
    groups = []
    for more in ({"spare": 1}, {"spare": 2}, {"hot_shard": 2}, {"hot_shard": 20, "spare": 2}, {"per_bucket": 3}):
        roots = simhash.components(simhash.links(frame, len(codes), 4, **more).selectExpr("fp_a as a", "fp_b as b"))
        groups.append({r.node: r.root for r in roots.collect()})
    assert len(groups[0]) > 100 and all(g == groups[0] for g in groups)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 255)), min_size=1, max_size=40, unique=True), st.integers(0, 5))
def test_bk_forest_finds_all_within_the_radius(nodes, radius):
    nodes.sort()
    tree, values = np.array([t for t, _ in nodes]), np.array([v for _, v in nodes], np.uint64)
    forest = simhash.BKForest(values, tree)
    found = {(int(q), int(n)) for a, b in forest.search(np.arange(len(nodes)), radius) for q, n in zip(a, b)}
    assert found == {(i, j) for i in range(len(nodes)) for j in range(len(nodes)) if tree[i] == tree[j] and (nodes[i][1] ^ nodes[j][1]).bit_count() <= radius}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and got[101] == 100


def test_one_row_of_each_component_whatever_the_ids(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(12)]
    near = texts[5].replace(" ", "  ", 3)  # the same shingles, another text
    rows = [*[(None, t) for t in texts[:4]], (None, texts[0]), *[(7, t) for t in texts[4:8]], (7, near), (3, texts[8]), (None, texts[8]), *[(i, t) for i, t in enumerate(texts[9:])]]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(" ".join(r.text.split()) for r in got) == sorted(texts)
    assert {r.text: r.doc_id for r in got}[texts[8]] == 3
    again = simhash.keep_one(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
