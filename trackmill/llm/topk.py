"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are integers floor(SCALE * x). Candidates are dealt by length into groups of about GROUP, longest
first, and stored. A query's threshold is its k-th best score so far; it starts from a sample of
the candidates. A query goes to the groups only whose longest vector could reach its threshold, in packed
blocks of up to QUERIES, through a shuffle: neither the queries nor the candidates pass the driver, which knows
the groups' greatest lengths and the sample alone. A task holds one group, in buckets of similar lengths,
and one block of queries after the other; where there are more than PART queries, each group is sent to several tasks, which share them. In a bucket whose longest vector has length l a query needs a
cosine of threshold / (|q| l): over 1, the bucket and all shorter ones are skipped. Otherwise the
bucket chooses: where that cosine leaves few vectors in the range that the query's largest
coordinate allows, only these are verified (coordinate pruning); where it does not, all vectors that
are long enough are (length pruning), as one matrix product.

Groups return at most k rows for a query, which are ranked once more.

Defined cases: vec_id must be a whole number (a TypeError else), other columns are not looked at; vectors that are null or hold null or non-finite components take no part, rows
without id neither; shorter vectors count as filled up with zeros, and an odd long one only makes its own block or bucket wide, which then holds fewer rows
(WIDTH components at most); an empty vector is all zeros; equal vectors are different
candidates; no row with a query's id is a candidate of its; rows that share a query's id are
queries by themselves, each with its own answer (equal rows with equal ones); scores are whole
numbers up to 2**53, beyond which doubles round; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, save, whole_ids

SCALE = 64
K = 20
#: queries in a block
QUERIES = 2048
#: candidates in a group, on average, which a task holds packed
GROUP = 1 << 19
_ROWS = "group int, part int, length double, blob binary"
#: queries that a task answers for its group, about; components of a block or bucket
PART, WIDTH = 1 << 16, 1 << 23
#: candidates from which thresholds start, on average
SAMPLE = 8192
BUCKET = 4096
#: coordinate pruning must leave less than this share of a bucket
FEW = 0.05
_BLOCK = 512


def matrix(column: pa.Array, scale: int, dim: int | None = None) -> np.ndarray:
    """The scaled vectors as rows; missing components are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.asarray(column.offsets)
    size = np.diff(off)
    values = np.floor(scale * np.asarray(column.values, np.float64)[off[0] : off[-1]])
    dim = int(size.max(initial=0)) if dim is None else dim
    out = np.zeros((len(size), max(dim, 1)))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(values)) - np.repeat(off[:-1] - off[0], size)
    ok = at < out.shape[1]  # beyond the longest query, products are 0
    out[row[ok], at[ok]] = values[ok]
    return out


def runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First and last + 1 of runs of at most so many vectors and, as a matrix, WIDTH components."""
    size, a = np.diff(np.asarray(column.offsets)), 0
    while a < len(size):
        wide = np.maximum.accumulate(np.maximum(size[a : a + most], 1)) * np.arange(1, len(size[a : a + most]) + 1)
        b = a + max(1, int(np.searchsorted(wide, WIDTH, "right")))
        yield a, b
        a = b


class Best:
    """The k best candidates of each query so far; ties go to smaller ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.q, self.k, self.floor = ids, q, k, floor.copy()
        self.length = np.sqrt((q * q).sum(1))
        self.of = np.zeros(0, np.int64)
        #: pairs verified after coordinate pruning, pairs multiplied after length pruning, pairs in all
        self.looked = [0, 0, 0]
        self.vec, self.score = np.zeros(0, np.int64), np.zeros(0)

    def add(self, of: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        of, vec, score = np.r_[self.of, of], np.r_[self.vec, vec], np.r_[self.score, score]
        order = np.lexsort((vec, -score, of))
        of, vec, score = of[order], vec[order], score[order]
        first = np.searchsorted(of, of)
        rank = np.arange(len(of)) - first
        last = rank == self.k - 1
        self.floor[of[last]] = np.maximum(self.floor[of[last]], score[last])
        keep = rank < self.k
        self.of, self.vec, self.score = of[keep], vec[keep], score[keep]

    def bucket(self, ids: np.ndarray, p: np.ndarray, length: np.ndarray) -> None:
        """Candidates of similar lengths, longest first; length is that of their whole vectors."""
        if not len(ids):
            return
        self.looked[2] += len(self.q) * len(ids)
        wide = min(self.q.shape[1], p.shape[1])  # beyond the narrower, products are 0
        q, p = self.q[:, :wide], p[:, :wide]
        need = self.floor / np.maximum(self.length * length[0], 1e-300)
        able = np.flatnonzero(need <= 1 + 1e-12)
        focus = np.abs(q).argmax(1)
        unit = p / np.maximum(length, 1e-300)[:, None]
        by = {f: np.argsort(unit[:, f]) for f in np.unique(focus[able]).tolist()} if (need[able] > 0.5).any() else {}
        whole = []
        for i in able.tolist():
            if by and need[i] > 0.5:
                f = int(focus[i])
                c, x = min(need[i], 1.0), q[i, f] / max(self.length[i], 1e-300)
                reach = np.sqrt(max(0.0, (1 - c * c) * (1 - x * x))) + 1e-9
                own = unit[by[f], f]
                # a cosine of c or more keeps this coordinate within an angle of arccos(c) of the query's
                low = -1.0 if np.arccos(np.clip(x, -1, 1)) + np.arccos(c) > np.pi else c * x - reach
                high = 1.0 if np.arccos(np.clip(x, -1, 1)) < np.arccos(c) else c * x + reach
                a, b = np.searchsorted(own, low, "left"), np.searchsorted(own, high, "right")
                if b - a < FEW * len(ids):
                    at = by[f][a:b]
                    self.looked[0] += len(at)
                    s = p[at] @ q[i]
                    ok = (s >= self.floor[i]) & (ids[at] != self.ids[i])
                    if ok.any():
                        self.add(np.full(int(ok.sum()), i), ids[at[ok]], s[ok])
                    continue
            whole.append(i)
        whole = np.array(whole, np.int64)
        for lo in range(0, len(whole), _BLOCK):
            at = whole[lo : lo + _BLOCK]
            long = int(np.searchsorted(-length, -np.min(self.floor[at] / np.maximum(self.length[at], 1e-300)) + 1e-9 * max(1.0, length[0]), "right")) if (self.floor[at] > 0).all() else len(ids)
            if not long:
                continue
            self.looked[1] += len(at) * long
            s = q[at] @ p[:long].T
            s[self.ids[at][:, None] == ids[:long][None, :]] = -np.inf
            best = self.floor[at]
            if long > self.k:
                best = np.maximum(best, np.partition(s, long - self.k, axis=1)[:, long - self.k])
            r, c = np.nonzero((s >= best[:, None]) & (s > -np.inf))
            self.add(at[r], ids[c], s[r, c])


def _grouped(scale: int):
    """A group's vectors as packed buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        for batch in batches:
            for a, b in runs(batch.column(1), BUCKET):
                vec = np.asarray(batch.column(0).slice(a, b - a))
                p = matrix(batch.column(1).slice(a, b - a), scale)
                length = float(np.sqrt((p * p).sum(1)).max())
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([0], pa.int32()), pa.array([length]), pa.array([_packed(vec, p)], pa.binary())], names=["group", "part", "length", "blob"])

    return run


def _packed(ids: np.ndarray, p: np.ndarray, *more: np.ndarray) -> bytes:
    """ids, rows and further columns of numbers; rows in the narrowest kind that holds them."""
    import io

    if len(p) and np.abs(p).max() < 1 << 15:
        p = p.astype(np.int16)
    out = io.BytesIO()
    np.savez(out, ids, p, *more)
    return out.getvalue()


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import io

    with np.load(io.BytesIO(blob)) as found:
        return [found[k] for k in found.files]


def _sent(sample, groups, scale: int, k: int, n_parts: int):
    """Blocks of queries with their thresholds, for each group that may hold an answer; blocks take turns with the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sample_ids, sample_p = sample.value
        at, longest = groups.value
        turn = TaskContext.get().partitionId()
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in runs(whole.column(2), QUERIES)):
            ids, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            q = matrix(batch.column(2), scale)
            wide = min(q.shape[1], sample_p.shape[1])
            floor = np.full(len(ids), -np.inf)
            for a in range(0, len(ids), _BLOCK):
                s = q[a : a + _BLOCK, :wide] @ sample_p[:, :wide].T
                s[ids[a : a + _BLOCK][:, None] == sample_ids[None, :]] = -np.inf
                if s.shape[1] >= k:
                    floor[a : a + _BLOCK] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            length, turn = np.sqrt((q * q).sum(1)), turn + 1
            for group, most in zip(at.tolist(), longest.tolist(), strict=True):
                some = np.flatnonzero(floor <= length * most * (1 + 1e-12))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([turn % n_parts], pa.int32()), pa.array([0.0]), pa.array([_packed(ids[some], q[some], key[some], floor[some])], pa.binary())], names=["group", "part", "length", "blob"])

    return run


def _met(k: int):
    """Rows of a group and part: its buckets, longest first, then blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, buckets = None, []
        for batch in batches:
            for group, part, is_query, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (group, part) != here:
                    here, buckets = (group, part), []
                if not is_query:
                    buckets.append(blob)
                    continue
                ids, q, key, floor = _unpacked(blob)
                best = Best(ids, q.astype(np.float64), k, floor)
                for packed in buckets:
                    vec, p = _unpacked(packed)
                    p = p.astype(np.float64)
                    length = np.sqrt((p * p).sum(1))
                    order = np.lexsort((vec, -length))
                    best.bucket(vec[order], p[order], length[order])
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.of]), pa.array(key[best.of]), pa.array(best.vec), pa.array(best.score.astype(np.int64))], names=["query_id", "key", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, *, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k candidates with the highest inner products for each row that is_query holds for."""
    whole_ids(vectors, "vec_id")
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), is_query.alias("_asks"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    # equal rows are one query, as often as they come
    queries = rows.where("_asks").groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).select("vec_id", F.xxhash64("embedding").alias("key"), "embedding", "times")
    rows = rows.select("vec_id", "embedding", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), 2))).alias("length"))
    total, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a sample of WIDTH components at most
    few = max(1, min(SAMPLE, WIDTH // max(1, dim)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(-(-total // few))) == 0).select("vec_id", "embedding").toArrow()
    dealt = rows.repartitionByRange(max(-(-total // GROUP), min(parts(spark), -(-total // BUCKET))), F.desc("length"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("length")).select("vec_id", "embedding")
    buckets = save(dealt.mapInArrow(_grouped(scale), _ROWS))
    # a row for some GROUP vectors
    groups = buckets.groupBy("group").agg(F.max("length").alias("length")).orderBy("group").toArrow()
    known = spark.sparkContext.broadcast((np.asarray(sample["vec_id"]), matrix(sample["embedding"], scale)))
    lengths = spark.sparkContext.broadcast((np.asarray(groups["group"]), np.asarray(groups["length"])))
    queries = save(queries)
    n_parts = -(-max(1, queries.count()) // PART)
    sent = queries.select("vec_id", "key", "embedding").mapInArrow(_sent(known, lengths, scale, k, n_parts), _ROWS)
    own = buckets.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).select(*[c.split()[0] for c in _ROWS.split(", ")])
    met = own.withColumn("is_query", F.lit(False)).union(sent.withColumn("is_query", F.lit(True))).repartition(max(parts(spark), groups.num_rows * n_parts), "group", "part")
    met = met.sortWithinPartitions("group", "part", "is_query", F.desc("length")).select("group", "part", "is_query", "blob")
    found = met.mapInArrow(_met(k), "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    again = queries.where("times > 1").select(F.col("vec_id").alias("query_id"), "key", "times")
    best = best.join(again, ["query_id", "key"], "left").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return best.select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


#: fixed values: scale, k and the query ids of above
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
