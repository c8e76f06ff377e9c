from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from quillgrid.llm import token_counts
from tests.llm.frames import awkward_documents, empty_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    t = Tokenizer.from_file(PATH)
    return Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in rows)


def test_awkward_rows(spark):
    frame = awkward_documents(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert Counter(map(tuple, token_counts.digest(frame, PATH).collect())) == want(rows)


def test_specials_and_odd_characters_and_a_tiny_cache(spark):
    odd = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "՘ ࢏ x", "\U0002ceae\U0002ceab", "'s 're don't I'LL", " 　 x​  y", "\x1c\x1d a", "१२३ ½ ²", "\U00040001 a"]
    rows = list(enumerate(odd + [f"word{i} number{i}" for i in range(60)]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parameters in ({}, {"room": 2, "table": 3}, {"sample": 1, "table": 0}):
        assert Counter(map(tuple, token_counts.digest(frame, PATH, **parameters).collect())) == want(rows)


def test_empty(spark):
    assert token_counts.digest(empty_documents(spark), PATH).count() == 0
