"""What the text operators share: the folder for intermediate tables and a vectorised tokenizer.

Executors do the text work on whole Arrow batches with numpy. Words are byte ranges of the
batch's own buffer and are named by 64-bit fingerprints, so no Python string is made per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.workspace import shared_dir

#: Text bytes that are tokenized together; a longer document is taken alone.
CHUNK = 1 << 20

_U = np.uint64
_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: folders of the operators that run, the innermost last
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside, unless it is to last, goes when the block ends."""
    path = shared_dir(spark)
    token = _SCRATCH.set((*_SCRATCH.get(), path))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which outlives any executor. A lasting one stays as long as the block around the innermost, or the session."""
    spark, roots = df.sparkSession, _SCRATCH.get()
    roots = roots[:-1] if lasting else roots
    path = f"{roots[-1]}/{uuid.uuid4().hex}" if roots else f"{shared_dir(spark)}/table"
    # nothing reads its shuffles once it is written; their files would stay until the driver happens to collect its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def whole_ids(docs: DataFrame, column: str = "doc_id") -> None:
    """Refuses ids that have no order as whole numbers."""
    if not isinstance(docs.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be a whole number, not {docs.schema[column].dataType.simpleString()}")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trim() -> None:
    """Gives freed memory back, so that a worker that is used again does not keep what its largest batch took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# --------------------------------------------------------------------------- fingerprints


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolling:
    """Fingerprints of ranges of a sequence, each from two prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base | 1, pow(base | 1, -1, 1 << 64), 0

    def __reduce__(self):
        return Rolling, (self.base,)  # without the powers

    def _grow(self, n: int) -> None:
        if n > self.n or not self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[_U(1), np.full(self.n, _U(b))], dtype=np.uint64) for b in (self.base, self.inverse))

    def sums(self, x: np.ndarray) -> np.ndarray:
        self._grow(len(x))
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, x: np.ndarray, k: int) -> np.ndarray:
        """One for each of len(x) - k + 1 windows, across whatever borders the sequence has."""
        n = len(x) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        s = self.sums(x)
        return mix((s[k:] - s[:n]) * self.down[:n])


_BYTES, WORDS, WORDS2 = (Rolling(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407))

# ------------------------------------------------------------------------------ tokenizer

_ALL = np.arange(256, dtype=np.uint8)
FOLD = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: bytes of [^\x20\x09-\x0D]+
SPACED = ~np.isin(_ALL, [32, 9, 10, 11, 12, 13])
#: bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
WORDLIKE = ((FOLD >= 48) & (FOLD <= 57)) | ((FOLD >= 97) & (FOLD <= 122)) | (_ALL >= 128)


class Words:
    """The words of some texts: buf[start[i]:end[i]] is word i, those of text d are first[d] to first[d + 1]."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool):
        is_word = kind[buf]
        self.buf = FOLD[buf] if fold else buf
        n = len(buf)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = is_word[:-1], is_word[1:]
            before[offsets[:-1][offsets[:-1] < n]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return _BYTES.ranges(_BYTES.sums(_ODD[self.buf]), self.start, self.end)

    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most so many bytes, or one longer text: first, last + 1, bytes, offsets."""
    buf, off = strings(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def array_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values).cast(kind, safe=False)


# --------------------------------------------------------------------------------- blobs


def pack(*columns: np.ndarray) -> bytes:
    """Equally long columns as one compressed string; neighbours in a sorted column compress well."""
    import zstandard

    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() if len(c) else b"" for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(columns[0])).tobytes() + raw)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n).T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def cut(order: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal values in a sorted array, both ends included."""
    if not len(order):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(order[1:] != order[:-1]) + 1, len(order)]


def spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    if not len(count):
        return np.zeros(0, np.int64)
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
