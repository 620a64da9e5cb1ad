"""Shared parts of the training-data operators: tables, shared storage, Arrow scans and word hashing.

Nulls: a null text is read as empty; a null id stays null. Empty tables give empty results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at.
CHUNK = 1 << 19
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Largest side that is broadcast; anything larger is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Which bytes part words: white space, or every ASCII character but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[k for k in range(128) if not chr(k).isalnum()]] = True
_PLAIN = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _PLAIN.copy()
_LOWER[0x41:0x5B] += np.uint64(32)
_POWERS: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and Spark's Arrow buffers hold of a batch, unless the session says how much it may be."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; a local one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        root = context.getCheckpointDir().get()
    return f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as Parquet in the shared folder, read again."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tally:
    """Counts of 64-bit keys by name, held up to a number of keys and then handed on, so memory has a bound."""

    def __init__(self, most: int = 1 << 21) -> None:
        self.most, self.size = most, 0
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, name: str, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.held.setdefault(name, []).append((found, n))
        self.size += len(found)

    def full(self) -> bool:
        if self.size > self.most:
            for name, parts_ in self.held.items():
                self.held[name] = [summed(*(np.concatenate(x) for x in zip(*parts_, strict=True)))]
            self.size = sum(len(x[0][0]) for x in self.held.values())
        return self.size > self.most // 2

    def taken(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for name, parts_ in self.held.items():
            yield name, *summed(*(np.concatenate(x) for x in zip(*parts_, strict=True)))
        self.held, self.size = {}, 0


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the sums of their n."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the counted rows stay below the limit; df should be cheap to count (written())."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and the n + 1 places where its rows begin and end; no copy of the text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column, kind = column.cast(pa.string()), np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive rows [i, j) of about limit bytes together; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about limit bytes of text."""
    for i, j in runs(utf8(batch.column(column))[1], limit):
        yield batch.slice(i, j - i)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, CHUNK + 1)
        for name, step in (("up", _BASE), ("down", inverse)):
            x = np.full(size, step, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, separator: np.ndarray = WHITE, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and first bytes of the words of UTF-8 bytes, A-Z lower-cased if fold; by default words are [^\\x20\\x09-\\x0D]+.

    Works through the bytes in chunks that end at separators, so a very long text needs little more than its words.
    """
    hashes, firsts, pos, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    while pos < n:
        end = min(n, pos + CHUNK)
        if end < n:
            gaps = np.flatnonzero(separator[data[pos:end]])
            while not len(gaps) and end < n:  # a word longer than the chunk
                grown = min(n, end + CHUNK)
                gaps = np.flatnonzero(separator[data[end:grown]])
                gaps, end = gaps + (end - pos), grown
            end = pos + int(gaps[-1]) + 1 if len(gaps) else n
        part = data[pos:end]
        edge = np.diff((~separator[part]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            up, down = _powers(len(part) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER if fold else _PLAIN)[part] * up[: len(part)])])
            hashes.append(mixed((total[stop] - total[start]) * down[start]))
            firsts.append(start + pos)
        pos = end
    return np.concatenate(hashes), np.concatenate(firsts)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; with fewer words, of the whole sequence as one; without words, none."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k]
    return mixed(h)


def word_hashes_of_rows(data: np.ndarray, at: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several rows and where each row's begin; rows are parted by a line end so that no word spans two."""
    n = len(at) - 1
    if n == 1:
        words, _ = word_hashes(data[at[0] : at[1]], separator)
        return words, np.array([0, len(words)])
    lengths = np.diff(at)
    joined = np.full(int(lengths.sum()) + n, 10, np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    keep = np.ones(len(joined), bool)
    keep[begin[1:] - 1] = False
    joined[keep] = data[at[0] : at[-1]]
    words, places = word_hashes(joined, separator)
    return words, np.searchsorted(places, begin)
