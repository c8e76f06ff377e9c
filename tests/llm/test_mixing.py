from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.llm import mixing
from tests.llm.frames import awkward_documents, empty_documents


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 40), st.integers(1, 50)), min_size=1))
def test_deviation_stays_below_one_block(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    plan = mixing.schedule(blocks, weights)
    assert [p[2] for p in plan] == list(range(sum(blocks.values())))
    assert Counter(p[0] for p in plan) == Counter({s: n for s, n in blocks.items() if n})
    for s in blocks:
        assert [p[1] for p in plan if p[0] == s] == list(range(blocks[s]))
    assert all(release <= slot < deadline for _, _, slot, release, deadline, _ in plan)
    left = Counter({s: n for s, n in blocks.items() if n})
    for phase in range(max((p[5] for p in plan), default=-1) + 1):
        own = [p for p in plan if p[5] == phase]
        live = [s for s in left if left[s]]
        total, had = sum(weights[s] for s in live), Counter()
        for t, p in enumerate(own, 1):
            had[p[0]] += 1
            assert all(abs(Fraction(t * weights[s], total) - had[s]) < 1 for s in live)
        left.subtract(had)


def test_every_row_has_one_place(spark):
    frame = awkward_documents(spark)
    for parameters in ({}, {"block": 2, "weights": {"s0": 0.7, "s1": 0.2}}, {"block": 1, "max_blocks": 4}, {"max_sources": 2, "block": 2}, {"per_stratum": 1, "block": 3}):
        mixed = mixing.mix(frame, **parameters)
        rows = mixed.collect()
        assert sorted(r.mix_position for r in rows) == list(range(frame.count()))
        assert mixed.columns[: len(frame.columns) - 1] == [c for c in frame.columns if c != "mix_position"]
        assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((r.doc_id, r.text, r.source) for r in frame.collect())
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)


def test_shares_follow_the_weights(spark):
    frame = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(3000)], "doc_id long, source string")
    rows = mixing.mix(frame, {"a": 0.5, "b": 0.5}, block=10).collect()
    first = [r.source for r in sorted(rows, key=lambda r: r.mix_position)][:1000]
    assert abs(first.count("a") - 500) <= 10
    again = mixing.mix(frame.repartition(7), {"a": 0.5, "b": 0.5}, block=10, per_stratum=1).collect()
    assert {r.doc_id: r.mix_position for r in rows} == {r.doc_id: r.mix_position for r in again}


def test_empty(spark):
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_targets_hold_over_max_sources(spark):
    rows = [*["hot"] * 600, *[f"s{i}" for i in range(30) for _ in range(20 + 20 * (i % 2))]]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, source string")
    mixed = mixing.mix(frame, {"hot": 0.6, "s0": 0.02}, block=5, max_sources=3).orderBy("mix_position").collect()
    assert [r.mix_position for r in mixed] == list(range(len(rows)))
    had = Counter()
    for t, r in enumerate(mixed[:800], 1):
        had[r.source] += 1
        assert abs(had["hot"] - t / 2) < 10  # 0.6 of 0.6 + 30 * 0.02
        assert all(abs(had[f"s{i}"] - t / 60) < 10 for i in range(30))
    mixed = mixing.mix(frame, temperature=1.0, block=5, max_sources=3).orderBy("mix_position").collect()
    had = Counter()
    for t, r in enumerate(mixed, 1):
        had[r.source] += 1
        assert all(abs(had[s] - t * n / len(rows)) < 10 for s, n in Counter(rows).items())
