"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, one scan of each text.

Item and document texts are normalised alike (A-Z lower-cased, every other ASCII character that is
no letter or digit a separator). The automaton is built once in each Python worker, from items whose
size is checked first: items that could make more than ``slice_nodes`` nodes go to further automata, each
with a pass over the texts of its own that returns what it found, so what a worker holds at once stays
bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, as_id, folded_words, materialise, packed, texts, type_of

_SPANS = pa.list_(pa.list_(pa.int64()))
_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def build(items: list[tuple[str, bytes | None]], window: int) -> ahocorasick.Automaton | None:
    """The automaton over the windows of all items; None if no item has a word."""
    patterns: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = folded_words(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            patterns.setdefault(b" %b " % b" ".join(words[i : i + k]), (k, set()))[1].add(item)
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, (k, names) in patterns.items():
        automaton.add_word(pattern.decode("latin-1"), (k, tuple(sorted(names))))
    automaton.make_automaton()
    return automaton


def _machine(mark: str, items: list[tuple[str, bytes | None]], window: int) -> ahocorasick.Automaton | None:
    """Built once in a worker process."""
    if mark not in _BUILT:
        _BUILT.clear()  # at most one stays in a worker
        _BUILT[mark] = build(items, window)
    return _BUILT[mark]


def merged(spans) -> list[list[int]]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def scan(text: bytes | None, automaton: ahocorasick.Automaton | None) -> tuple[int, list[list[int]], list[str]]:
    """Words of the text, merged [first, last + 1) word spans inside windows, items with windows there."""
    words = folded_words(text)
    line = b" %b " % b" ".join(words)
    found = list(automaton.iter(line.decode("latin-1"))) if words and automaton is not None else []
    if not found:
        return len(words), [], []
    before = np.cumsum(np.frombuffer(line, np.uint8) == 32)
    spans = merged([int(before[end]) - 1 - k, int(before[end]) - 1] for end, (k, _) in found)
    return len(words), spans, sorted({name for _, (_, names) in found for name in names})


def original_spans(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Word spans as [begin, end) byte offsets of the text as it came."""
    if not spans:
        return []
    word = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    return [[int(begins[a]), int(ends[b - 1])] for a, b in spans]


def _slices(benchmark: DataFrame, window: int, slice_nodes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in slices of bounded size; a slice at a time is on the driver."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.encode(text, "UTF-8").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total) * window // slice_nodes  # a byte is in ``window`` windows
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item, bytes(r.text)) for r in rows.filter(part == k).select("item", "text").distinct().toLocalIterator()]


def find(documents: DataFrame, benchmark: DataFrame, window: int = 13, slice_nodes: int = 1 << 22, carry: bool = False) -> DataFrame:
    """doc_key (with carry, also text and row), n_words, spans (of words), items, byte_spans (in the text's UTF-8), row by row of documents.

    An item shorter than a window, but not empty, is one window; empty and null items have none. A
    null text has no words. Items with one id count as one; a null item_id counts as the item "null".
    Repeated documents are judged one by one. A node is about 40 bytes in a worker and twice that while they
    are made, so the default bound is about 170 MB, from 0.3 MB of items.
    """
    spark = documents.sparkSession
    rows = packed(documents)
    if not carry:
        rows = rows.select("doc_key", "text")

    def machines(items):
        mark = hashlib.sha256(repr((window, sorted(items))).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(items)
        return lambda: _machine(mark, sent.value, window)

    def hits(items) -> DataFrame:
        """doc_key, mark, spans, items of the rows where this slice's items are found, written to the shared folder."""
        machine = machines(items)

        def run(batches):
            for batch in batches:
                out = [(i, *scan(t, machine())[1:]) for i, t in enumerate(texts(batch["text"]))]
                out = [x for x in out if x[1]]
                at = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_key"].take(at), batch["mark"].take(at), pa.array([x[1] for x in out], _SPANS), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["doc_key", "mark", "spans", "items"])

        marked = rows.select("doc_key", "text", F.xxhash64("text").alias("mark"))
        return materialise(marked.mapInArrow(run, "doc_key long, mark long, spans array<array<long>>, items array<string>"), "hits")

    slices = _slices(benchmark, window, slice_nodes)
    now, others = next(slices), None
    for later in slices:
        found = hits(now)
        others = found if others is None else others.unionAll(found)
        now = later
    carried = rows.columns
    rows = rows.withColumns({"other_spans": F.lit(None).cast("array<array<long>>"), "other_items": F.lit(None).cast("array<string>")}) if others is None else _joined(rows, others)
    given = [c for c in carried if carry or c == "doc_key"]
    machine = machines(now)

    def run(batches):
        for batch in batches:
            raw, out = texts(batch["text"]), []
            for t, spans, items in zip(raw, batch["other_spans"].to_pylist(), batch["other_items"].to_pylist()):
                n, own, names = scan(t, machine())
                out.append((n, merged([*own, *spans]), sorted({*names, *items})) if spans else (n, own, names))
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in given} | {
                "n_words": pa.array([x[0] for x in out], pa.int64()), "spans": pa.array([x[1] for x in out], _SPANS),
                "items": pa.array([x[2] for x in out], pa.list_(pa.string())),
                "byte_spans": pa.array([original_spans(t, x[1]) for t, x in zip(raw, out)], _SPANS),
            })

    schema = ", ".join(f"{c} {type_of(rows, c)}" for c in given)
    return rows.mapInArrow(run, f"{schema}, n_words long, spans array<array<long>>, items array<string>, byte_spans array<array<long>>")


def _joined(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows with what the other slices found in them; texts without a hit have none."""
    found = others.groupBy("doc_key", "mark").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("other_spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("other_items"))
    return rows.withColumn("mark", F.xxhash64("text")).join(found, ["doc_key", "mark"], "left").drop("mark")


def n_hit() -> Column:
    """Words inside the spans."""
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0]), F.lit(0))


def contaminated() -> Column:
    """A hit, and hits in at least 5 % of the words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def digest(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    return find(documents, benchmark, **parameters).select(
        as_id("doc_key").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
    WITH d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least(13, len(ws)) AS k FROM (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS pattern FROM b, UNNEST(range(1, len(ws) - k + 2)) AS u(i)),
    dk AS (SELECT doc_id, ws, k FROM d, (SELECT DISTINCT k FROM bw)),
    dw AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS pattern FROM dk, UNNEST(range(1, len(ws) - k + 2)) AS u(i)),
    h AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, pattern)),
    hit AS (SELECT doc_id, count(DISTINCT i + j.j) AS n FROM h, range(0, 13) AS j(j) WHERE j.j < k GROUP BY 1),
    t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN t USING (doc_id)"""
