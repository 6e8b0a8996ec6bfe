"""What several operators share: table access, word hashes and shingles in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import ship

#: Words of a shingle, the entries at which a worker's word cache is emptied, and the bytes of a batch that become Python objects at once.
SHINGLE = 5
CACHE = 250_000
PART = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """Whole numbers as a DataFrame. Arrow takes them to the JVM; rows of Python objects would start Python workers of another kind on each executor."""
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``more``; any other column is dropped before the scan."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], size: int = PART) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in slices of about ``size`` bytes, a row at least, without copying.

    Spark's batches have 10,000 rows, tens of MB of text; a worker that turns one into
    Python objects at once keeps that memory for all later stages.
    """
    for b in batches:
        rows = max(1, b.num_rows * size // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; bytes.lower and bytes.split do just that."""
    return text.lower().split()


class WordHashes(dict):
    """Word to 64-bit hash, remembered by the worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, of: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, of), np.uint64, len(of))


#: One for all operators of a worker process.
HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    A text with fewer than k words has one shingle, its whole sequence; a text
    without words has none.
    """
    h = hashes.array(words(text))
    n = len(h)
    if not n:
        return h
    span = min(k, n)
    acc = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        acc = acc * _P + h[i : n - span + 1 + i]
    return np.unique(mix(acc))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    """Arrow lists from numpy arrays, without Python objects for the values."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts).view(kind) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def forest(a: np.ndarray) -> np.ndarray:
    """For a boolean matrix of links between rows and columns, the root row of each row and column that has a link, or -1."""
    rows, cols = np.full(a.shape[0], -1), np.full(a.shape[1], -1)
    for p in np.flatnonzero(a.any(1)):
        if rows[p] >= 0:
            continue
        front = a[p] & (cols < 0)
        rows[p] = p
        while front.any():
            cols[front] = p
            more = a[:, front].any(1) & (rows < 0)
            rows[more] = p
            front = a[more].any(0) & (cols < 0) if more.any() else np.zeros_like(front)
    return np.concatenate([rows, cols])
