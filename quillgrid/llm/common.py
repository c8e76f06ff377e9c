"""Helpers shared by the training-data operators: byte-level words, Arrow access, shared storage."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator: it sorts after every real id. A real id of this value is taken for null.
NULL_ID = (1 << 63) - 1

#: ASCII translation: A-Z to a-z, every ASCII byte outside [0-9a-z] to a space; bytes over 0x7F stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

#: The same separators as a pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def key_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def as_id(column: str | Column) -> Column:
    """The document id again: the stand-in becomes null."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID))


def texts(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, null as None."""
    return column.cast(pa.binary()).to_pylist()


def in_slices(raw: list[bytes | None], limit: int = 1 << 19):
    """(begin, end) of runs of texts of about ``limit`` bytes: what is made of them at once stays small."""
    begin, size = 0, 0
    for i, t in enumerate(raw):
        n = len(t or b"")
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(raw):
        yield begin, len(raw)


def give_back() -> None:
    """Hand freed memory back to the system: a worker process outlives its tasks, and its heap with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def plain_words(text: bytes | None) -> list[bytes]:
    """Words [^ \\t\\n\\v\\f\\r]+ of a text; none for null."""
    return text.split() if text else []


def folded_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for null."""
    return text.translate(FOLD).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), on whole arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Lists that the folders made from now on are noted in: that of the process, and one for each ``scratch`` in force.
_NOTED: list[list[str]] = [[]]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one in spark.checkpoint.dir, which the driver and all executors see.

    Only where the session names none, and runs on one machine (as in tests), is a local folder set.
    It is removed when the process ends, or before by ``discard``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for noted in _NOTED:
        noted.append(folder)
    return folder


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it; also on executors."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def discard(folders: Iterable[str]) -> None:
    """Remove folders that nothing reads any more; what is gone already, or in a store not known here, is passed over."""
    for folder in folders:
        try:
            store, path = open_store(folder)
            store.delete_dir(path)
        except (OSError, pa.ArrowException):
            continue


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders made inside, in order."""
    made: list[str] = []
    _NOTED.append(made)
    try:
        yield made
    finally:
        _NOTED.remove(made)


atexit.register(lambda: discard(_NOTED[0]))


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def keep_share(key: Column, share: Column | float) -> Column:
    """True for about that share of all keys, always the same ones."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < share * F.lit(float(1 << 30))


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def packed(documents: DataFrame) -> DataFrame:
    """doc_key, text, and all other columns in one struct ``row``, whatever their names are."""
    rest = [documents[c] for c in documents.columns if c != "text"]
    return documents.select(key_id().alias("doc_key"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("row"))


def unpacked(frame: DataFrame, columns: list[str]) -> list[Column]:
    """The columns that ``packed`` took in, in their order."""
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]


def type_of(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()
