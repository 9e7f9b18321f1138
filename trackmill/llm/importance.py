"""Target-distribution importance resampling over hashed word n-grams, counted and scored in word tries.

Features of a text are its runs of 1 to N words (A-Z lower-cased, joined by one space), repeats counted. A feature's bucket is
the CRC-32 of its bytes modulo BUCKETS. The gain of a bucket is the logarithm of how much more often
the target (the benchmark) falls into it than the documents do, smoothed by one, in whole thousandths. A
document's weight is the sum of its features' gains. With Gumbel noise from a hash of its doc_id, the
highest scores are a sample without replacement in proportion to exp(weight).

A task builds tries of the words that it reads, TRIE bytes of text at a time (a longer document alone), so that a trie's memory is
bounded and no trie leaves its task. A node is a word behind its parent; it holds how often its path from
the root stands in the texts and the CRC state of that path, made from its parent's state and the word's own
CRC. Counts of nodes go to bucket totals, which are BUCKETS sums whatever the
input, and these are all that is shuffled. To score, tries are built again, each node gets the sum of gains along its
path, and every word of a document adds the value of the deepest node that it leads to.

Ranks need an order of all documents: one exchange by ranges of the score, with the id of equal scores
and a row's own number behind, so no range grows with ties; a row's place is its place in the range and the sizes of the ranges before.

Defined cases: null, empty and wordless texts have no features, weight 0 and a score of noise alone; they are too short to be drawn;
an empty benchmark or table leaves the smoothing alone; a null doc_id is hashed as the empty string and comes after others of equal score; repeated
rows have equal scores and may all be drawn, each with a rank of its own; words and texts may be of any length; other columns are not looked at.
Words are told apart by 64-bit fingerprints within a trie.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDLIKE, Words, chunks, parts, save, scratch, trim, whole_ids

N, BUCKETS, SEED = 3, 10_000, 42
#: words that a drawn document has at least, and how many of a hundred such documents are drawn
LEAST_WORDS, PERCENT = 20, 5
#: bytes of text whose words share a trie
TRIE = 4 << 20
#: words up to so many bytes extend CRC states by table
SHORT = 63

_U32 = np.uint32


def _tables() -> np.ndarray:
    """Four tables of 256 for each number k of bytes: xor-ing what they hold for a CRC's bytes is the CRC's part in that of a string k bytes longer."""
    step = np.arange(256, dtype=_U32)
    for _ in range(8):
        step = np.where(step & _U32(1), (step >> _U32(1)) ^ _U32(0xEDB88320), step >> _U32(1))
    state = (np.arange(256, dtype=_U32)[None, :] << (8 * np.arange(4, dtype=_U32))[:, None]).reshape(-1)
    out = [state]
    for _ in range(SHORT + 1):
        state = (state >> _U32(8)) ^ step[state & _U32(255)]
        out.append(state)
    return np.concatenate(out)


class Trie:
    """The trie of the words of some texts: levels[j] has each node's count and CRC state, path[j] the node at depth j + 1 that starts at each word (-1: the text ends before)."""

    def __init__(self, w: Words, tables: np.ndarray, depth: int = N):
        self.words = w
        name, first, word = np.unique(w.hashes(), return_index=True, return_inverse=True)
        size = (w.end - w.start)[first]
        self.own = np.fromiter((zlib.crc32(w.buf[s:e]) for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)), _U32, len(name))
        spaced = np.fromiter((zlib.crc32(w.buf[s:e], 0xE96CCF45) for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)), _U32, len(name))
        left, at = w.left(), word
        self.path, self.levels = [word], [(np.bincount(word, minlength=len(name)), self.own)]
        for j in range(1, depth):
            begin = np.flatnonzero(left > j)
            child = at[begin] * len(name) + word[begin + j]
            key, node = np.unique(child, return_inverse=True)
            parent, last = np.divmod(key, max(len(name), 1))
            state = self._behind(self.levels[-1][1][parent], last, size, spaced, first, tables)
            at = np.full(len(word), -1)
            at[begin] = node
            self.path.append(at)
            self.levels.append((np.bincount(node, minlength=len(key)), state))

    def _behind(self, state: np.ndarray, last: np.ndarray, size: np.ndarray, spaced: np.ndarray, first: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """States behind one more space and word."""
        far = np.flatnonzero(size[last] > SHORT)
        row = np.minimum(size[last] + 1, SHORT + 1) * 1024
        out = spaced[last].copy()
        for b in range(4):
            out ^= tables[row + 256 * b + ((state >> _U32(8 * b)) & _U32(255))]
        for i in far.tolist():
            f = first[last[i]]
            out[i] = zlib.crc32(self.words.buf[self.words.start[f] : self.words.end[f]], zlib.crc32(b" ", int(state[i])))
        return out

    def totals(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(state % _U32(buckets), count, buckets) for count, state in self.levels).astype(np.int64)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Each text's sum of gains over its features, by walking from every word to its deepest node."""
        value, before, up_at = np.zeros(len(self.path[0]), np.int64), None, None
        for (count, state), at in zip(self.levels, self.path, strict=True):
            held = gains[state % _U32(len(gains))]
            here = np.flatnonzero(at >= 0)
            if before is not None:  # a node's parent is the same for all that pass it
                up = np.zeros(len(count), np.int64)
                up[at[here]] = before[up_at[here]]
                held = held + up
            value[here] = held[at[here]]
            before, up_at = held, at
        sums = np.r_[0, np.cumsum(value)]
        return sums[self.words.first[1:]] - sums[self.words.first[:-1]]


def features(words: np.ndarray, depth: int = N) -> np.ndarray:
    return sum(np.maximum(words - j, 0) for j in range(depth))


def _totals(depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = _tables(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0), TRIE):
                sums += Trie(Words(buf, off, WORDLIKE, True), tables, depth).totals(buckets)
            trim()
        bucket = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(sums[bucket])], names=["bucket", "n"])

    return run


def _weights(gains, text_at: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables()
        for batch in batches:
            count, found, weight = [], [], []
            for _, _, buf, off in chunks(batch.column(text_at), TRIE):
                trie = Trie(w := Words(buf, off, WORDLIKE, True), tables, depth)
                count.append(w.count)
                found.append(features(w.count, depth))
                weight.append(trie.weights(gains.value))
            made = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (count, found, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], *made], names=[*(f"c{i}" for i in range(text_at)), "n_words", "n_features", "weight"])
            trim()

    return run


def bucket_totals(texts: DataFrame, column: str = "text", depth: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, how many features fall into it; buckets without any are left out."""
    return texts.select(F.col(f"`{column}`").cast("string")).mapInArrow(_totals(depth, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, depth: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths; on the driver, as it is of a fixed size."""
    s, t = ({r.bucket: r.n for r in bucket_totals(x, depth=depth, buckets=buckets).collect()} for x in (docs, target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (all_s + buckets) / ((s.get(b, 0) + 1.0) * (all_t + buckets)))) for b in range(buckets)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, *, depth: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    whole_ids(docs)
    value = docs.sparkSession.sparkContext.broadcast(gains(docs, target, depth, buckets))
    bare = docs.select(F.col("doc_id").cast("long").alias("c0"), F.col("text").cast("string").alias("text"))
    out = bare.mapInArrow(_weights(value, 1, depth), "c0 long, n_words long, n_features long, weight long")
    return out.select(F.col("c0").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("c0"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, depth: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """What scored() gives, and rank: 1, 2, 3 ... of the documents drawn, null for the others."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = save(scored(docs, target, depth=depth, buckets=buckets, seed=seed)).withColumn("open", F.col("n_words") >= least_words)
        own = F.xxhash64(F.monotonically_increasing_id())  # only for rows that are equal otherwise
        order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("own")]
        ranged = rows.withColumn("own", own).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
        # a row's id is its partition's number, shifted, and its place there
        placed = save(ranged.drop("own").withColumn("at", F.monotonically_increasing_id()), lasting=True)
    part = F.shiftright("at", 33)
    sizes = sorted((r.p, r.all, r.open) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("all"), F.count(F.when(F.col("open"), 1)).alias("open")).collect())  # a row a partition
    drawn = percent * sum(x[2] for x in sizes) // 100
    held = np.zeros(max((x[0] for x in sizes), default=0) + 1, np.int64)
    for p, all_, _ in sizes:
        held[p] = all_
    rank = (F.get(F.lit((np.cumsum(held) - held).tolist()), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text")).drop("n_words")


def _crc() -> str:
    """CRC-32 of b, a list of a string's bytes: one table of 256, worked out bit by bit."""
    step = list(range(256))
    for _ in range(8):
        step = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in step]
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda s, x: xor(s >> 8, ({step})[(xor(s, x) & 255) + 1])), 4294967295)"


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
target AS (SELECT {_WORDS} AS w FROM benchmark),
found AS (
  SELECT r, array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), asked AS (
  SELECT array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM target, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), named AS (
  SELECT f, {_crc()} % 10000 AS bucket
  FROM (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM (SELECT f FROM found UNION SELECT f FROM asked))
), s AS (SELECT bucket, count(*) AS s FROM found JOIN named USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM asked JOIN named USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM found) + 10000e0) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM asked) + 10000e0)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), weighed AS (SELECT r, sum(gain) AS weight, count(*) AS n FROM found JOIN named USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= 20 AS open, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (r)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 5 * (SELECT count(*) FROM scored WHERE open) // 100 THEN place END AS rank FROM ranked
"""
