"""Small awkward tables, and what they should come to by plain Python."""

import random
import re

LONG = " ".join(f"w{i % 977}" for i in range(40_000))
CLASHING = ["doc_key", "row", "batch", "bucket", "fp", "component", "n_words", "mark", "line", "word", "label", "mix_position", "pool", "stratum", "score", "spans", "items", "kept", "dim", "vec", "g", "h", "key", "digest"]


def awkward_texts():
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("an", "er", "ou", "ti", "le")]
    passage = " ".join(rnd.choices(words, k=60))
    base = " ".join(rnd.choices(words, k=120))
    near = base.split()
    near[50] = "CHANGED"
    out = [None, "", " \n\t ", "one", "Zwei Wörter", "x " * 500, LONG, base, base, " ".join(near), passage, "pre " + passage + "  post"]
    out += [" ".join(rnd.choices(words, k=n)) for n in (3, 4, 12, 13, 14, 40)]
    out += [passage[:40] + " " + " ".join(rnd.choices(words, k=30)) + "\n" + passage, "Ünïcode line é x\x1cy " * 4, "a\x0bb\x0cc\rd"]
    return out


def awkward_documents(spark):
    """Null ids, null texts, repeated rows, ties, and columns named like an operator's own."""
    rows = [(i * 3 + 1, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(awkward_texts())]
    rows += [rows[7], rows[7], (None, rows[10][1], "en", "s1", 5), (None, None, None, None, None), (1, "same id, other text", "fr", "s0", 3)]
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
