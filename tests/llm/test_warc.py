import gzip
import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F
from quillgrid.llm import warc


def brute(rows):
    keeper = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            keeper[raw] = max(keeper.get(raw, -(1 << 63)), -(1 << 63) if page is None else page)
    out = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        late = raw in keeper and (-(1 << 63) if page is None else page) < keeper[raw]
        out[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if late else "response", keeper[raw] if late else None)] += 1
    return out


@pytest.fixture
def pages(spark):
    big, rows = "é<p>x</p>" * 200, []
    for i in range(60):
        rows.append((i, f"http://www.example{i % 4}.com:80/a/{i % 7}?q={i}", [None, "", "short", big, big + "y", f"{i}" * 1500, "a\r\n\r\nWARC/1.1\r\n"][i % 7]))
    rows += [(7, "http://x.org/", big), (7, "http://x.org/", big), (None, None, big), (None, "odd url\r\nX: y", None), (100, "https://user@Host.ORG/ü ", "z" * 999), (101, "", "z" * 1000), (102, "http://hot.net/", "h"), *[(200 + i, "http://hot.net/", "h") for i in range(50)]]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, key int, digest int")


def test_round_trip(pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = warc.digest(pages).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def own_file(name):
    return name.removeprefix("file://")


def test_archives_are_warc_files(spark, pages):
    captures = warc.write_archives(pages).orderBy("archive", "offset").collect()
    assert len(captures) == pages.count()
    for name in {c.archive for c in captures}:
        own = [c for c in captures if c.archive == name]
        with open(own_file(name), "rb") as f:
            data = f.read()
        assert [c.offset for c in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and len(data) == sum(c.length for c in own)
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") == len(own)


def test_lookup_of_some_keys(spark, pages):
    captures = warc.write_archives(pages)
    index = warc.build_index(captures, per_block=5)
    assert index.agg(F.sum("captures")).first()[0] == pages.count()
    want = Counter(map(tuple, captures.collect()))
    for keys in (["net,hot)/"], ["com,example1,www)/a/1?q=1", "nothing)/", None], sorted({k[0] for k in want})):
        found = warc.lookup(index, spark.createDataFrame([(k,) for k in keys], "key string"))
        assert Counter(map(tuple, found.collect())) == Counter({k: n for k, n in want.items() if k[0] in keys})


def test_a_lookup_reads_its_own_bytes_only(spark, pages):
    """All other bytes of index blocks and archives are overwritten: they are not looked at."""
    captures = warc.write_archives(pages)
    index = warc.build_index(captures, per_block=5)
    key = captures.filter("key like 'org,host)%'").first().key
    blocks = [(r.file, r.offset, r.length) for r in index.collect() if r.first_key.encode() <= key.encode() <= r.last_key.encode()]
    places = [(r.archive, r.offset, r.length) for r in captures.filter(F.col("key") == key).collect()]
    assert len(places) == 1 and sum(b[2] for b in blocks) < index.agg(F.sum("length")).first()[0]
    for name in {r[0] for r in index.select("file").union(captures.select("archive")).collect()}:
        with open(own_file(name), "r+b") as f:
            data = f.read()
            f.seek(0)
            blank = bytearray(len(data))
            for _, a, n in [p for p in blocks + places if p[0] == name]:
                blank[a : a + n] = data[a : a + n]
            f.write(blank)
    found = warc.read_records(warc.lookup(index, spark.createDataFrame([(key,)], "key string"))).collect()
    assert [r.page_key for r in found] == [100] and found[0].payload_bytes == 999


def test_ranges(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(bytes(range(200)))
    name = f"file://{path}"
    wanted = [(name, 10, 5), (name, 15, 5), (name, 100, 0), (name, 40, 1), (name, 10, 5)]
    assert [list(x) for x in warc.read_ranges(wanted)] == [list(range(a, a + n)) for _, a, n in sorted(wanted)]


def test_empty(spark, pages):
    assert warc.digest(pages.limit(0)).count() == 0


def test_damage_is_seen():
    raw = warc.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse(raw)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n", b"paYload\r\n"))


def test_keys(spark):
    rows = spark.createDataFrame([("HTTP://WWW.Ab.co.UK:8080/X?y#z",), ("a.b",), ("http://a.b?q",), (None,)], "url string")
    assert [r.k for r in rows.select(warc.capture_key(F.col("url")).alias("k")).collect()] == ["uk,co,ab,www)/X?y#z", "b,a)", "b,a)?q", ")"]


def test_control_characters_in_urls(spark):
    urls = [f"http://a{c}b.com{c}/x{c}y{c}{c}" for c in "\0\1\2\n\x1f\""] + ["http://a", "http://b.com\1/", "http://b.com/\0", "http://b.com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.digest(pages).collect()) == list(range(len(urls)))
    index = warc.build_index(warc.write_archives(pages), per_block=2, per_segment=3)
    keys = pages.select(warc.capture_key(F.col("url")).alias("key"))
    assert warc.lookup(index, keys).count() == len(urls)
    halves = [(k.key.split(c)[0],) for k in keys.collect() for c in "\0\1" if c in k.key]
    own = {k.key for k in keys.collect()}
    assert warc.lookup(index, spark.createDataFrame([h for h in halves if h[0] not in own], "key string")).count() == 0
