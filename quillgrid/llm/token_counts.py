"""Token counts of whole texts by a two-tier lookup beside the text: no pre-token is ever shuffled.

Tier one, a broadcast table, has the token lengths of the most frequent pre-tokens of a bounded sample
of documents; tier two is a cache in each Python worker, which the tokenizer library fills one missing
pre-token at a time. The sample only decides what is in the table at the start: a pre-token's length is
the library's in either tier, so counts do not depend on it.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, keep_share, key_id, texts

#: Fixed value: the pre-token pattern of byte-level BPE. White space is Unicode's property, as the library has it.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
    return _LOADED[path]


@lru_cache(1)
def _odd_characters() -> str:
    """A pattern of the characters that the library's Unicode tables and ours see differently.

    Planes that have no characters yet count as different without a look.
    """
    from tokenizers import pre_tokenizers

    cut, find = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, regex.compile(PIECES).findall
    odd = []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)):
        probe = f"a{chr(code)}a1 {chr(code)}{chr(code)}  {chr(code)}."
        if [b - a for _, (a, b) in cut(probe)] != list(map(len, find(probe))):
            odd.append(regex.escape(chr(code)))
    return "[" + "".join(odd) + "\U00034000-\U000DFFFF\U000E0200-\U0010FFFF]"


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Lengths(dict):
    """Tokens of each pre-token: the broadcast table first, then what this worker has encoded."""

    def __init__(self, path: str, frequent: dict[str, int], room: int):
        super().__init__(frequent)
        self.encode, self.frequent, self.room = _tokenizer(path).encode, frequent, room

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece, add_special_tokens=False).ids)
        if len(self) - len(self.frequent) >= self.room:  # bounded memory: begin again with tier one
            self.clear()
            self.update(self.frequent)
        self[piece] = n
        return n


def _specials(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def _frequent(documents: DataFrame, path: str, sample: int, size: int) -> tuple[str, bytes]:
    """Frequent pre-tokens joined by U+0000, and their lengths as bytes; longer than 255 tokens: left out."""
    total = documents.count()
    if not total or not size:
        return "", b""
    some = documents.filter(keep_share(F.col("doc_id").cast("string"), sample / total) & (F.octet_length("text") <= 1 << 16)).select("text").limit(2 * sample)
    find, counts = regex.compile(PIECES).findall, Counter()
    for row in some.toLocalIterator():
        counts.update(find(row.text))
    encode = _tokenizer(path).encode
    pairs = [(p, len(encode(p, add_special_tokens=False).ids)) for p, _ in counts.most_common(size) if "\0" not in p]
    pairs = [x for x in pairs if x[1] < 256]
    return "\0".join(p for p, _ in pairs), bytes(n for _, n in pairs)


def count_tokens(documents: DataFrame, path: str, sample: int = 2000, table: int = 1 << 16, room: int = 1 << 19) -> DataFrame:
    """doc_key, n_bytes, n_tokens of every row, for the byte-level BPE in ``path`` (a tokenizers .json).

    sample: documents (about so many, each of at most 64 KB) whose pre-tokens fill the broadcast table
    of at most ``table`` entries; room: entries of a worker's cache. Null texts count as empty: 0 and 0.
    Texts with a special token's string, or with a character that the Unicode tables of the two
    libraries see differently, are encoded by the tokenizer library whole, as its default has it. Ids
    may be null or repeated; rows are counted one by one.
    """
    if not path.endswith(".json"):
        raise ValueError("a tokenizers .json file is asked for")
    spark = documents.sparkSession
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast((*_frequent(documents, path, sample, table), _odd_characters()))

    def run(batches):
        joined, counts, odd = sent.value
        lengths = _Lengths(path, dict(zip(joined.split("\0") if counts else [], counts)), room)
        find, look, specials = regex.compile(PIECES).findall, lengths.__getitem__, _specials(path)
        whole, strange = _tokenizer(path).encode, regex.compile(odd).search
        for batch in batches:
            raw = texts(batch["text"])
            out = []
            for t in raw:
                text = (t or b"").decode("utf-8", "replace")
                if any(s in text for s in specials) or not _is_latin(text) and strange(text):
                    out.append(len(whole(text, add_special_tokens=False).ids))
                else:
                    out.append(sum(map(look, find(text))))
            n_bytes = pa.array([len(t or b"") for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_key"], n_bytes, pa.array(out, pa.int64())], ["doc_key", "n_bytes", "n_tokens"])

    return documents.select(key_id().alias("doc_key"), "text").mapInArrow(run, "doc_key long, n_bytes long, n_tokens long")


def digest(documents: DataFrame, path: str, limit: int = 1024, **parameters) -> DataFrame:
    counted = count_tokens(documents, path, **parameters)
    return counted.select(as_id("doc_key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
