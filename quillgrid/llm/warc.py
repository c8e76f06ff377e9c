"""WARC archives of pages, and a two-level capture index over them.

Writing: one gzip member for each record, each task's members one .warc.gz file in the shared folder.
Of equal payloads of a least size one record is the response and the others are revisits of it.

Index: capture keys with reversed hosts are range-partitioned and sorted; every ``per_block`` keys
become one compressed block, a segment (one range) is a file of blocks. The sparse directory has each
block's first and last key and its place in the file, the top directory one entry for each segment.
A lookup searches the top directory and the segment's directory by bisection, reads the byte ranges
of the blocks found, searches those by bisection, and then reads the byte ranges of the records.

Files are opened through Arrow's file systems, so the shared folder is on a local path that all
machines see, or in HDFS, S3, GCS or ABFS. A task that runs again writes a file of its own; only the
places that its last attempt returned are used.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, open_store, partitions, shared_folder

_LEAST_ID = -(1 << 63)  # stands for a null page_id: before all others
_CAPTURES = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_DIRECTORY = pa.schema([
    ("segment", pa.int32()), ("block", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("first_key", pa.string()), ("last_key", pa.string()), ("captures", pa.int32()),
])
_RECORDS = pa.schema([
    ("page_key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers", pa.int64()), ("target_uri", pa.string()),
])
_AT_ONCE = 1 << 22  # bytes of one read, and of the records unpacked at once


def capture_key(url: Column) -> Column:
    """``com,example,host)/path?query`` of a URL, the host in lower case and without its port; null: empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header (with the payload's length) but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page, type, digest, length and refers_to of a record; a response's digest is checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda s: int(s.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_key": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "target_uri": fields["WARC-Target-URI"],
    }


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long' if f.type == pa.int64() else 'string'}" for f in schema)


def _new_file(folder: str, label: str, ending: str):
    """A new file of this task's attempt in the shared folder: its name there and a stream into it."""
    task = TaskContext.get()
    store, path = open_store(folder)
    name = f"{label}-{task.partitionId():06d}-{task.taskAttemptId()}.{ending}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)


def _file(name: str):
    folder, _, own = name.rpartition("/")
    store, path = open_store(folder)
    return store.open_input_file(f"{path}/{own}")


def _made(frame: DataFrame, label: str) -> str:
    folder = shared_folder(frame.sparkSession, label)
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    return folder


def read_ranges(wanted: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes at (file, offset, length), file by file; ranges that touch are read together, others are not."""
    wanted = sorted(wanted)
    name, source, at = None, None, 0
    try:
        while at < len(wanted):
            if wanted[at][0] != name:
                if source is not None:
                    source.close()
                name = wanted[at][0]
                source = _file(name)
            begin = end = wanted[at][1]
            upto = at
            while upto < len(wanted) and wanted[upto][0] == name and wanted[upto][1] <= end and (upto == at or wanted[upto][1] + wanted[upto][2] - begin <= _AT_ONCE):
                end = max(end, wanted[upto][1] + wanted[upto][2])
                upto += 1
            data = source.read_at(end - begin, begin)
            for _, offset, length in wanted[at:upto]:
                yield data[offset - begin : offset - begin + length]
            at = upto
    finally:
        if source is not None:
            source.close()


def write_archives(pages: DataFrame, least_payload: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 5) -> DataFrame:
    """Writes .warc.gz files to the shared folder; key, archive, offset, length of every record in them.

    A null html is an empty payload; a null or empty url is about:blank. Of equal payloads of at least
    ``least_payload`` bytes the one with the largest page_id is the response; repeated rows of that
    page are responses too. A null page_id sorts before all others. An empty table gives no records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_LEAST_ID)).alias("page_key"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= least_payload
    repeated = rows.filter(large).groupBy("digest").agg(F.max("page_key").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(repeated, "digest", "left")
    rows = rows.select("page_key", "url", "html", "digest", F.when(large & (F.col("page_key") < F.col("keeper")), F.col("keeper")).alias("refers"), capture_key(F.col("url")).alias("key"))
    folder = _made(pages, "warc")

    def run(batches):
        name, stream = _new_file(folder, "pages", "warc.gz")
        with stream:
            offset = 0
            for batch in batches:
                out = []
                for page, url, html, digest, refers, key in zip(*(batch[c].to_pylist() for c in ("page_key", "url", "html", "digest", "refers", "key"))):
                    member = gzip.compress(record(page, url, html.encode("utf-8", "replace"), digest, refers, date), level, mtime=0)
                    stream.write(member)
                    out.append({"key": key, "archive": name, "offset": offset, "length": len(member)})
                    offset += len(member)
                yield pa.RecordBatch.from_pylist(out, schema=_CAPTURES)

    return materialise(rows.mapInArrow(run, _ddl(_CAPTURES)), "captures")


def build_index(captures: DataFrame, per_block: int = 1000, per_segment: int = 1 << 20) -> DataFrame:
    """Writes the blocks of captures (key, archive, offset, length) to segment files; the sparse directory of them:
    segment, block, file, offset, length, first_key, last_key, captures.

    A segment has about ``per_segment`` captures or less, also where one key has most of them.
    """
    n = max(partitions(captures.sparkSession), -(-captures.count() // per_segment))
    place = ["key", "archive", "offset"]
    ordered = captures.select(*_CAPTURES.names).repartitionByRange(n, *place).sortWithinPartitions(*place)
    folder = _made(captures, "index")

    def run(batches):
        name, stream = _new_file(folder, "segment", "blocks")
        with stream:
            segment, block, offset, lines = TaskContext.get().partitionId(), 0, 0, []

            def cut(lines):
                data = zlib.compress(json.dumps([*zip(*lines)], ensure_ascii=False).encode())  # one list for each column; any character may be in a key
                stream.write(data)
                row = {"segment": segment, "block": block, "file": name, "offset": offset, "length": len(data), "first_key": lines[0][0], "last_key": lines[-1][0], "captures": len(lines)}
                return len(data), pa.RecordBatch.from_pylist([row], schema=_DIRECTORY)

            for batch in batches:
                lines += zip(*(batch[c].to_pylist() for c in _CAPTURES.names))
                while len(lines) >= per_block:
                    size, row = cut(lines[:per_block])
                    lines, block, offset = lines[per_block:], block + 1, offset + size
                    yield row
            if lines:
                yield cut(lines)[1]

    return materialise(ordered.mapInArrow(run, _ddl(_DIRECTORY)), "directory")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """key, archive, offset, length of every capture of the distinct ``key``s asked for; unknown and null keys find none.

    The top directory has one row for each segment. Of the index files only the blocks are read whose
    span of keys has a key that is asked for.
    """
    spark = index.sparkSession
    top = index.groupBy("segment").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()
    top = sorted(((r.first.encode(), r.last.encode(), r.segment) for r in top), key=lambda x: x[2])
    sent = spark.sparkContext.broadcast(top)

    def route(batches):
        firsts, lasts = [x[0] for x in sent.value], [x[1] for x in sent.value]
        for batch in batches:
            out = []
            for key in batch["key"].to_pylist():
                raw = key.encode()
                out += [{"key": key, "segment": sent.value[i][2]} for i in range(bisect_left(lasts, raw), bisect_right(firsts, raw))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("segment", pa.int32())]))

    def find(wanted: pa.Table, directory: pa.Table) -> pa.Table:
        rows = sorted(zip(*(directory[c].to_pylist() for c in ("block", "first_key", "last_key", "file", "offset", "length"))), key=lambda r: r[0])
        firsts, lasts = [r[1].encode() for r in rows], [r[2].encode() for r in rows]
        asked: dict[int, list[bytes]] = {}
        for key in wanted["key"].to_pylist():
            raw = key.encode()
            for i in range(bisect_left(lasts, raw), bisect_right(firsts, raw)):
                asked.setdefault(i, []).append(raw)
        blocks, found = sorted(asked), [[], [], [], []]
        # the blocks of a segment stand in its file in order, as read_ranges returns them
        for i, data in zip(blocks, read_ranges([rows[i][3:] for i in blocks])):
            columns = json.loads(zlib.decompress(data))
            names = [x.encode() for x in columns[0]]
            for raw in asked[i]:
                a, b = bisect_left(names, raw), bisect_right(names, raw)
                for whole, column in zip(found, columns):
                    whole += column[a:b]
        return pa.table([pa.array(c, f.type) for c, f in zip(found, _CAPTURES)], schema=_CAPTURES)

    wanted = keys.select("key").filter("key is not null").distinct().mapInArrow(route, "key string, segment int")
    return wanted.groupBy("segment").cogroup(index.groupBy("segment")).applyInArrow(find, _ddl(_CAPTURES))


def read_records(captures: DataFrame, stretch: int = 1 << 25) -> DataFrame:
    """The records at (archive, offset, length), unpacked and checked; nothing else of the archives is read.

    Places in one ``stretch`` of an archive's bytes go to one task.
    """

    def run(batches):
        for batch in batches:
            wanted = list(zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length"))))
            rows, size = [], 0
            for member in read_ranges(wanted):
                raw = gzip.decompress(member)
                rows.append(parse(raw))
                size += len(raw)
                if size > _AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    places = captures.select("archive", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / stretch))
    places = places.repartition(partitions(captures.sparkSession), "archive", "stretch").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(run, _ddl(_RECORDS))


def digest(pages: DataFrame, least_payload: int = 1000) -> DataFrame:
    """Archives of all pages, read back by looking up every page's key in the index."""
    index = build_index(write_archives(pages, least_payload))
    records = read_records(lookup(index, pages.select(capture_key(F.col("url")).alias("key"))))
    real = lambda c: F.nullif(F.col(c), F.lit(_LEAST_ID))
    return records.select(real("page_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", real("refers").alias("refers_to"))


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    k AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= 1000 GROUP BY html)
    SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
           CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < keeper THEN keeper END AS refers_to
    FROM p LEFT JOIN k USING (html)"""
