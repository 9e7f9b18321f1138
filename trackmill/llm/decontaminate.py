"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts are lower-cased in A-Z and cut into words. The windows of an item are its runs of N words;
an item with fewer has one window of all its words. Every document is scanned once, without a
shuffle: rolling fingerprints of its windows are looked up in the set, each hit is verified word
by word, and the words inside it are marked. The set is sorted arrays beside one buffer of words,
some 30 bytes a window.

It is broadcast only up to SET_BYTES of item text. The windows of a larger benchmark stay a table. A bitmap of
their fingerprints, of a fixed size, is broadcast instead; the windows of documents that pass it are
joined with the table by fingerprint and words, and what is found returns to the documents by a hash of their
text. Both ways read the documents' words once for hits, whatever the benchmark's size.

Defined cases: null or wordless texts have no words and no hits, null or wordless items no
windows; items that share an id count once; an item without id marks words but is not counted;
repeated rows have equal results; an empty table or benchmark gives no hits; columns of the
documents that are asked for go through unchanged, results stand in the one struct column `hit`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDLIKE, WORDS, Words, chunks, parts, spread, strings, trim

N = 10
#: bytes of item text whose windows are broadcast at once
SET_BYTES = 8 << 20
#: bits of the map of a larger benchmark's windows, in slices of SLICE
BITS, SLICE = 1 << 27, 1 << 16
_HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def normalised(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, each with a space after it, and where each begins."""
    size = w.end - w.start
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    step = spread(size)
    out[np.repeat(at, size) + step] = w.buf[np.repeat(w.start, size) + step]
    return out, at


def windows_of(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, first word, length and fingerprint of each item window."""
    h = w.hashes()
    k = np.minimum(w.count, n)
    size = np.where(k > 0, w.count - k + 1, 0)
    text = np.repeat(np.arange(len(k)), size)
    first, k = w.first[:-1][text] + spread(size), k[text]
    sums = WORDS.sums(h)
    return text, first, k, WORDS.ranges(sums, first, first + k)


class Grams:
    """Windows of items: by length, sorted fingerprints with place in the words' buffer and item."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.names, rows, bufs, before = [x[0] for x in items], [], [], 0
        for a, _, buf, off in chunks(pa.array([x[1] for x in items], pa.large_string())):
            w = Words(buf, off, WORDLIKE, True)
            words, at = normalised(w)
            text, first, k, x = windows_of(w, n)
            end = np.r_[at, len(words)][first + k] - 1
            rows.append((x, k.astype(np.int32), (before + at[first]).astype(np.int32) if len(first) else first.astype(np.int32), (end - at[first]).astype(np.int32) if len(first) else first.astype(np.int32), (text + a).astype(np.int32)))
            bufs.append(words)
            before += len(words)
        self.words = np.concatenate(bufs) if bufs else np.zeros(0, np.uint8)
        self.by: dict[int, tuple[np.ndarray, ...]] = {}
        self.memo: dict[tuple[int, int], dict[bytes, set]] = {}
        x, k, at, size, item = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
        for length in np.unique(k).tolist():
            own = np.flatnonzero(k == length)
            own = own[np.argsort(x[own], kind="stable")]
            seen = np.zeros(1 << 20, bool)
            seen[x[own] >> np.uint64(44)] = True
            self.by[length] = x[own], seen, at[own], size[own], item[own]

    def _of(self, k: int, j: int) -> dict[bytes, set]:
        """The windows with the j-th fingerprint of length k, and the items that have each."""
        if (k, j) not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            keys, _, at, size, item = self.by[k]
            found: dict[bytes, set] = defaultdict(set)
            for i in range(j, int(np.searchsorted(keys, keys[j], "right"))):
                found[self.words[at[i] : at[i] + size[i]].tobytes()] |= {self.names[item[i]]} - {None}
            self.memo[k, j] = dict(found)
        return self.memo[k, j]

    def hits(self, w: Words) -> Iterator[tuple[int, int, set]]:
        """First word, length and items of each verified occurrence, per length in order of place."""
        h, left = w.hashes(), w.left()
        for k, (keys, seen, *_) in self.by.items():
            x = WORDS.windows(h, k)
            at = np.flatnonzero(seen[x >> np.uint64(44)] & (left[: len(x)] >= k))
            where = np.minimum(np.searchsorted(keys, x[at]), len(keys) - 1)
            same = keys[where] == x[at]
            for i, j in zip(at[same].tolist(), where[same].tolist(), strict=True):
                words = b" ".join(w.buf[s:e].tobytes() for s, e in zip(w.start[i : i + k], w.end[i : i + k], strict=True))
                found = self._of(k, j)
                if words in found:
                    yield i, k, found[words]


def _scan(grams, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        known = pickle.loads(grams.value)
        for batch in batches:
            counts, marks, items = [], [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for a, _, buf, off in chunks(batch.column(text_at)):
                w = Words(buf, off, WORDLIKE, True)
                counts += w.count.tolist()
                hit, of, runs = np.zeros(len(w.start) + 1, np.int64), defaultdict(set), []
                for i, k, names in known.hits(w):
                    runs.append((i, i + k))
                    of[int(np.searchsorted(w.first, i, "right")) - 1] |= names
                if runs:
                    x = np.array(runs)
                    np.add.at(hit, x[:, 0], 1)
                    np.add.at(hit, x[:, 1], -1)
                    at = np.flatnonzero(np.cumsum(hit) > 0)
                    d = np.searchsorted(w.first, at, "right") - 1
                    for e in np.unique(d).tolist():
                        marks[a + e] = (at[d == e] - w.first[e]).tolist()
                    for e, names in of.items():
                        items[a + e] = sorted(names)
            kind = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            out = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], *batch.columns[text_at + 1 :], out], names=[*(f"c{i}" for i in range(batch.num_columns - 1)), "hit"])
            trim()

    return run


def _windows(n: int):
    """Windows of (item, text) rows with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, off in chunks(batch.column(1)):
                w = Words(buf, off, WORDLIKE, True)
                words, at = normalised(w)
                text, first, k, x = windows_of(w, n)
                ends = np.r_[at, len(words)]
                own = [words[s:e].tobytes() for s, e in zip(ends[first].tolist(), (ends[first + k] - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + a)), pa.array(x.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(own, pa.binary())], names=["item", "x", "k", "words"])
            trim()

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each slice that this task has all rows of."""
    maps: dict[int, np.ndarray] = {}
    for batch in batches:
        bit = np.asarray(batch.column(0))
        for s in np.unique(bit // SLICE).tolist():
            maps.setdefault(s, np.zeros(SLICE, bool))[bit[bit // SLICE == s] % SLICE] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int64()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], names=["slice", "bits"])


def _passed(bits, lengths: list[int]):
    """Document windows whose fingerprint is in the bitmap: the text's key, place, fingerprint, length and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        for batch in batches:
            for a, _, buf, off in chunks(batch.column(1)):
                w = Words(buf, off, WORDLIKE, True)
                h, left, text = w.hashes(), w.left(), w.text()
                words, at = normalised(w)
                ends = np.r_[at, len(words)]
                for k in lengths:
                    x = WORDS.windows(h, k)
                    i = np.flatnonzero(known[x % np.uint64(BITS)] & (left[: len(x)] >= k))
                    own = [words[s:e].tobytes() for s, e in zip(ends[i].tolist(), (ends[i + k] - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[i] + a)), pa.array((i - w.first[text[i]]).astype(np.int64)), pa.array(x[i].view(np.int64)), pa.array(np.full(len(i), k, np.int32)), pa.array(own, pa.binary())], names=["t", "place", "x", "k", "words"])
            trim()

    return run


def _joined(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """t (a hash of a text), places and items of the texts that hold a window of a benchmark of any size."""
    spark = texts.sparkSession
    windows = items.mapInArrow(_windows(n), "item string, x long, k int, words binary").groupBy("x", "k", "words").agg(F.collect_set("item").alias("items"))
    # as unsigned, fingerprints modulo a power of two are their low bits
    bits = windows.select(F.col("x").bitwiseAND(F.lit(BITS - 1)).alias("bit")).repartition(parts(spark), F.floor(F.col("bit") / SLICE)).mapInArrow(_bitmap, "slice long, bits binary")
    whole = bytearray(BITS // 8)
    for r in bits.toLocalIterator():  # BITS / 8 bytes in all, but for slices without a window
        whole[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = r.bits
    lengths = [r.k for r in windows.select("k").distinct().collect()]  # N at most
    passed = texts.mapInArrow(_passed(spark.sparkContext.broadcast(bytes(whole)), lengths), "t string, place long, x long, k int, words binary")
    met = passed.distinct().join(windows, ["x", "k", "words"])
    spans = F.flatten(F.transform(F.collect_set(F.struct("place", "k")), lambda s: F.sequence(s["place"], s["place"] + s["k"] - 1)))
    return met.groupBy("t").agg(F.array_sort(F.array_distinct(spans)).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, *, columns: list[str] | None = None, set_bytes: int = SET_BYTES) -> DataFrame:
    """The columns asked for (all, by default) and hit: n_words, the places of hit words, the ids of items that occur."""
    from pyspark import cloudpickle

    spark, columns = docs.sparkSession, docs.columns if columns is None else columns
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("text IS NOT NULL")
    held = items.select(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    few = held <= set_bytes
    grams = Grams([(r.item, r.text) for r in items.toLocalIterator()], n) if few else Grams([], n)
    bare = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.md5("text").alias(f"c{len(columns)}"), F.col("text").alias("text"))
    kinds = [docs.schema[c].dataType for c in columns] + [T.StringType()]
    plain = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)] + [T.StructField("hit", _HIT)])
    out = bare.mapInArrow(_scan(spark.sparkContext.broadcast(cloudpickle.dumps(grams)), len(kinds)), plain)
    if not few:
        texts = docs.where("text IS NOT NULL").select(F.md5("text").alias("t"), F.col("text").alias("text"))
        out = out.join(_joined(texts, items, n), F.col(f"c{len(columns)}") == F.col("t"), "left")
        none = F.col("hit")
        out = out.withColumn("hit", F.struct(none["n_words"].alias("n_words"), F.coalesce("places", none["words"]).alias("words"), F.coalesce("items", none["items"]).alias("items")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "hit")


def _as_rows(docs: DataFrame) -> DataFrame:
    """The columns as one struct, so that none can clash with results."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, **options) -> DataFrame:
    """The documents without any benchmark window, unchanged."""
    return scan(_as_rows(docs), benchmark, n, columns=["row"], **options).where(F.size("hit.words") == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, **options) -> DataFrame:
    """All documents; from a hit one the marked words go, and the other words stay, joined by one space."""
    out = scan(_as_rows(docs), benchmark, n, columns=["row"], **options)

    @F.pandas_udf(T.StringType())
    def rest(text, marks):
        import pandas as pd

        new = []
        for t, m in zip(text, marks, strict=True):
            w = Words(*strings(pa.array([t], pa.large_string())), WORDLIKE, True)
            gone, raw = set(m.tolist()), (t or "").encode()
            new.append(" ".join(raw[s:e].decode() for i, (s, e) in enumerate(zip(w.start, w.end, strict=True)) if i not in gone))
        return pd.Series(new)

    text = F.when(F.size("hit.words") > 0, rest("row.text", "hit.words")).otherwise(F.col("row.text"))
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.size("hit.words").cast("long")
    return scan(docs.select("doc_id", "text"), benchmark, columns=["doc_id"]).select(
        "doc_id", F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


EMPTY = hashlib.sha256(b"").hexdigest()
ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), gram AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM raw, (SELECT DISTINCT k FROM gram) WHERE len(w) >= k)
), hit AS (
  SELECT r, i, k, item FROM place JOIN gram USING (k, g)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM raw LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
