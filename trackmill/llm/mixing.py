"""Mixing sources to target weights (native: DataFrame functions only).

Tokens are aggregated per source, each source gets a share of the wanted total by weight, capped
at a multiple of what it has, and a document is emitted floor(rate) times plus one more with a
probability equal to the fraction, drawn from a hash of its id. Nothing is sorted or shuffled by
source but the per-source totals: those are combined map-side, and the targets return to the
documents as a broadcast while there are at most BROADCAST_SOURCES, else by a salted join.

Defined cases: a null text has size 0; a null source is a source of its own and the last one; a
source without words has target 0; rows with one doc_id share their draw; an empty table gives an
empty table; the input's columns are kept in one struct, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PERCENT = 150
CAP = 2
SEED = "mix-1"
#: rows of (source, two numbers) that are broadcast: some 10 MB
BROADCAST_SOURCES = 100_000
SALTS = 64


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """source, source_size and its target. sizes: one row of source and source_size for each source.

    The sources stand in order of the share that would fill their cap. The first whose fair share of
    what the earlier ones leave does not exceed its cap fixes the level for itself and all later ones.
    """
    common = math.lcm(*weights)
    byname = Window.orderBy(F.col("source").isNull(), "source")
    filling = Window.orderBy("fills", F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("nth", F.row_number().over(byname) - 1)
        .withColumn("w", w.cast("long"))
        .withColumn("fills", F.col("source_size") * (F.lit(common) / F.col("w")).cast("long"))
        .withColumn("before", F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("w_left", F.sum("w").over(whole) - F.sum("w").over(filling.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"))
        .withColumn("left", F.col("total") * percent - F.col("before") * (cap * 100))
        .withColumn("fits", F.col("left") * F.col("w") <= F.col("source_size") * F.col("w_left") * (cap * 100))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("fills", F.col("source").isNull().alias("n"), F.col("source").alias("s"), "left", "w_left"))).over(whole))
        .withColumn("open", F.max("fits").over(filling.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "source",
            "source_size",
            F.when(F.col("open") & (F.col("level.w_left") > 0), (F.col("level.left") * F.col("w")).cast("double") / (F.col("level.w_left") * 100).cast("double"))
            .otherwise((F.col("source_size") * cap).cast("double"))
            .alias("target"),
        )
    )


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: str = SEED, columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns asked for), doc_id, size, source_size, target, rate, copies, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]).alias("row")
    sized = docs.select(kept, F.col("doc_id").alias("doc_id"), F.col("source").alias("src"), size.alias("size"))
    totals = docs.select(F.col("source").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = save(targets(totals, weights, percent, cap))
    few = aims.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        joined = sized.join(F.broadcast(aims), F.col("src").eqNullSafe(F.col("source")))
    else:
        salted = aims.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = sized.withColumn("s", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
        joined = mine.join(salted, F.col("src").eqNullSafe(F.col("source")) & (F.col("s") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        joined.withColumn("rate", F.least(rate, F.lit(float(cap))))
        .withColumn("copies", (F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
        .select("row", "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    return plan(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs, columns=[]).select("doc_id", "size", "source_size", "target", "taken")


#: fixed values: the word pattern, weights, share and cap of above
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS w FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (6 // w), source IS NULL, source) AS k, sum(source_size) OVER () AS total FROM r
), f AS (
  SELECT *, total * 150 - 200 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM o
), l AS (
  SELECT k AS k0, rest AS rest0, w_rest AS w0 FROM f WHERE rest * w <= 200 * source_size * w_rest ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN k >= k0 THEN CAST(rest0 * w AS DOUBLE) / CAST(w0 * 100 AS DOUBLE) ELSE CAST(source_size * 2 AS DOUBLE) END AS target
  FROM f LEFT JOIN l ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p
"""
