"""SimHash near-duplicates: fingerprints, exact Hamming links by BK-trees in shards, components.

Links within ``radius`` differing bits are found without comparing all pairs: a fingerprint is cut
into blocks, and two that differ in at most ``radius`` bits agree in all blocks but ``radius`` of
them, so they meet in the shard of at least one choice of agreeing blocks. Each shard holds a BK-tree
(children keyed by the integer Hamming distance to their parent); a search follows only the edges
within the radius of the distance just measured. Trees are built and searched where their shard was
shuffled to: broadcasting them would send every distinct fingerprint to every executor, which has no
size bound. A shard returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_id, discard, give_back, key_id, materialise, packed, partitions, scratch, texts, unpacked

SEED = 42
_CHUNK = 1 << 16


def _fingerprint(text: bytes | None, size: int) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)  # the only shingle
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-size]]).tolist()
    digest, n = xxhash.xxh64_intdigest, len(begins)
    ends = (ends[size - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _CHUNK], ends[at : at + _CHUNK])], ">u8")
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _mark() -> Column:
    """What tells texts apart: their MD5, and nothing for null."""
    return F.coalesce(F.unhex(F.md5("text")), F.lit(b""))


def fingerprints(documents: DataFrame, shingle: int = 4, marked: bool = False) -> DataFrame:
    """doc_key, fp (the 64 bits as a signed long) of every row; null and empty texts have 0. With marked, also mark."""

    def run(batches):
        for batch in batches:
            prints = np.array([_fingerprint(t, shingle) for t in texts(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(prints.view(np.int64))], [*kept, "fp"])
            give_back()

    rows = documents.select(key_id().alias("doc_key"), F.col("text").cast("string").alias("text"))
    kept, schema = ["doc_key"], "doc_key long, fp long"
    if marked:
        rows, kept, schema = rows.withColumn("mark", _mark()), ["doc_key", "mark"], "doc_key long, mark binary, fp long"
    return rows.mapInArrow(run, schema)


class BKForest:
    """BK-trees of many shards at once, as arrays; built and searched level by level."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        """values: distinct 64-bit codes of each tree; tree: sorted numbers of the trees they belong to."""
        n = len(values)
        self.values = values
        self.parent = np.full(n, -1, np.int64)
        self.key = np.zeros(n, np.int64)
        first = np.concatenate([[True], tree[1:] != tree[:-1]])
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]  # the first code of each tree
        waiting, at = np.flatnonzero(~first), self.root[~first]
        while len(waiting):
            distance = np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
            slot = at * 65 + distance
            order = np.argsort(slot, kind="stable")
            new = np.concatenate([[True], slot[order][1:] != slot[order][:-1]])
            chosen = waiting[order][new]  # the first to reach a free edge becomes its child
            self.parent[chosen], self.key[chosen] = at[order][new], distance[order][new]
            rest = ~new
            waiting, at = waiting[order][rest], chosen[np.cumsum(new) - 1][rest]
        children = np.flatnonzero(self.parent >= 0)
        slot = self.parent[children] * 65 + self.key[children]
        order = np.argsort(slot)
        self.child, self.slot = children[order], slot[order]

    def search(self, queries: np.ndarray, radius: int):
        """Chunks of (query, node) with distance <= radius inside the query's own tree."""
        stack = [(queries[a : a + _CHUNK], self.root[queries[a : a + _CHUNK]]) for a in range(0, len(queries), _CHUNK)]
        while stack:
            query, node = stack.pop()
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.slot, node * 65 + np.maximum(distance - radius, 0))
            many = np.searchsorted(self.slot, node * 65 + np.minimum(distance + radius, 64), side="right") - low
            if total := int(many.sum()):
                child = self.child[np.repeat(low, many) + np.arange(total) - np.repeat(np.cumsum(many) - many, many)]
                query = np.repeat(query, many)
                stack += [(query[a : a + 16 * _CHUNK], child[a : a + 16 * _CHUNK]) for a in range(0, total, 16 * _CHUNK)]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b; label points to a smaller or equal member, roots to themselves."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``parts`` nearly equal pieces of 64 bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def _dealt(frame: DataFrame, pieces: list[tuple[int, int]], spare: int) -> DataFrame:
    """shard, fp: every fp in the shard of each choice of ``spare`` pieces, inside the shard that it has, if any."""

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy()
            bits = fp.view(np.uint64)
            cut = [(bits >> np.uint64(s)) & np.uint64(m) for s, m in pieces]
            for number, chosen in enumerate(combinations(range(len(pieces)), spare)):
                key = batch["shard"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)
                for c in chosen:
                    key = key * np.uint64(0x9E3779B97F4A7C15) + cut[c]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch["fp"]], ["shard", "fp"])

    return frame.select("shard", "fp").mapInArrow(run, "shard long, fp long")


def links(codes: DataFrame, n_codes: int, radius: int = 4, spare: int = 1, per_bucket: int = 1 << 17, hot_shard: int = 1 << 16) -> DataFrame:
    """fp_a, fp_b: a spanning forest, shard by shard, of all pairs of the ``n_codes`` distinct fp within ``radius`` bits.

    ``spare`` blocks have to agree beside the ``radius`` that may differ: 1 gives radius + 1 shard
    tables of about 64 / (radius + 1) bits, 2 gives more tables with longer keys, for more codes.
    Shards of over ``hot_shard`` codes are dealt once more, by finer blocks of the same bits: two codes that link
    agree in one of these as well. Buckets of shards have about ``per_bucket`` codes. All values give the same links.
    """
    parts = radius + spare
    n = partitions(codes.sparkSession)
    tables = len(list(combinations(range(parts), spare)))
    n_buckets = max(4 * n, -(-n_codes * tables // per_bucket))

    def join(table: pa.Table) -> pa.Table:
        shard, fp = table["shard"].to_numpy(), table["fp"].to_numpy()
        order = np.lexsort((fp, shard))
        shard, fp = shard[order], fp[order]
        forest = BKForest(fp.view(np.uint64), shard)
        label = np.arange(len(fp))
        for query, node in forest.search(np.arange(len(fp)), radius):
            other = query != node
            if other.any():
                _unite(label, query[other], node[other])
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"fp_a": fp[child], "fp_b": fp[label[child]]})

    shards = _dealt(codes.select(F.lit(0).cast("long").alias("shard"), "fp"), _blocks(parts), spare)
    if n_codes > hot_shard:  # else no shard can have so many
        hot = shards.groupBy("shard").count().filter(F.col("count") > hot_shard).select("shard")
        finer = _dealt(shards.join(hot, "shard", "left_semi"), _blocks(parts + 1), spare + 1)
        shards = shards.join(hot, "shard", "left_anti").unionAll(finer)
    dealt = shards.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(n_buckets)).cast("int"))
    return dealt.repartitionById(n, "bucket").groupBy("bucket").applyInArrow(join, "fp_a long, fp_b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b): alternating stars.

    Each round is written to the shared folder, so lineage stays short and lost executors cost a round.
    """
    with scratch() as rounds:
        now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        before, older = now, rounds
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        with scratch() as rounds:
            now = materialise(small.filter("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # equal edge sets: as many edges, none of them new
        done = now.count() == before.count() and now.join(before, ["a", "b"], "left_anti").isEmpty()
        discard(older)
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(documents: DataFrame, shingle: int = 4, radius: int = 4, marked: bool = False) -> DataFrame:
    """doc_key, fp, component (the smallest doc_key reachable), root (the smallest fp reachable) of every row.

    Components may share their smallest doc_key, where ids repeat or are null; they never share a root.
    With marked, mark is there too.
    """
    prints = materialise(fingerprints(documents, shingle, marked), "fingerprints")
    codes = materialise(prints.groupBy("fp").agg(F.min("doc_key").alias("least")), "codes")
    n_codes = codes.count()
    spare = 1 if n_codes < 1 << 25 else 2  # longer shard keys for more codes; the links are the same
    edges = links(codes, n_codes, radius, spare)
    roots = components(edges.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    members = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    labels = members.join(least, "root").select("fp", "component", "root")
    return prints.join(labels, "fp").select("doc_key", "fp", "component", "root", *(["mark"] if marked else []))


def near_duplicates(documents: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable by links) of every row.

    Null, empty and all-white texts have fingerprint zero and link like any other. Repeated rows come
    back as often as they came in. A null doc_id sorts after all others: a component of such rows
    alone has a null component_id. An empty table gives an empty result.
    """
    return labelled(documents, shingle, radius).select(
        as_id("doc_key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        as_id("component").alias("component_id"),
    )


def keep_one(documents: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows and columns of one document of every component, also where ids are null or shared by unrelated texts.

    The smallest id stays, of its texts the one with the smallest hash, and one row where both repeat.
    """
    members = labelled(documents, shingle, radius, marked=True)
    kept = members.groupBy("root").agg(F.min(F.struct("doc_key", "mark")).alias("first")).select("first.doc_key", "first.mark")
    rows = packed(documents).withColumn("mark", _mark()).join(kept, ["doc_key", "mark"], "left_semi").dropDuplicates(["doc_key", "mark"])
    return rows.select(*unpacked(rows, documents.columns))
