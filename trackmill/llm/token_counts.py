"""Token counts as delta-maintained rollups.

A change to the corpus is a signed row: an insert adds a document and its tokens, a delete takes them
away, a revised count takes the old ones away and adds the new ones, which may be of another
source, language or tokenizer version. A batch of changes is added up by these keys (map-side first,
so a source with a third of all rows is a few rows a task) and stored as one small delta under the
batch's id. Totals are sums over deltas, so their order does not matter. A batch counts from the
moment its marker exists; committing an id again does nothing, and a run that died before its marker
is written anew. compact() replaces deltas by their sum without forgetting their ids.

Defined cases: null keys are keys of their own; null counts are 0 tokens; totals of no document and
no token are left out; an empty batch is committed and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint"


def changes(rows: DataFrame, sign: int, *, version: Column, tokens: Column) -> DataFrame:
    """Signed changes: sign 1 for inserts, -1 for deletes. rows: source and lang of each document."""
    return rows.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), version.cast("string").alias("version"),
        F.lit(sign).cast("bigint").alias("docs"), (F.coalesce(tokens, F.lit(0)).cast("bigint") * sign).alias("tokens"),
    )


class Rollup:
    """Totals in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        fs, path = self._path("commits")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Whether the batch was new. rows as changes() makes them."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id is letters, digits, - and _")
        fs, marker = self._path("commits", batch_id)
        if fs.exists(marker):
            return False
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch_id}")
        return fs.createNewFile(marker)

    def _live(self) -> list[str]:
        """Deltas that count: those of committed batches that no committed sum has taken in."""
        done, taken = self.committed(), set()
        for batch in done:
            fs, path = self._path("sums", batch)
            if fs.exists(path):
                taken |= {x.getPath().getName() for x in fs.listStatus(path)}
        return [b for b in done if b not in taken]

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens."""
        live = [f"{self.folder}/deltas/{b}" for b in self._live()]
        rows = self.spark.read.schema(SCHEMA).parquet(*live) if live else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self, name: str) -> None:
        """One sum instead of the deltas so far; their markers stay, so their ids stay known."""
        live = self._live()
        fs, marker = self._path("commits", name)
        if len(live) < 2 or fs.exists(marker):
            return
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")
        for b in live:
            fs.create(self._path("sums", name, b)[1], True).close()
        fs.createNewFile(marker)


def bpe_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and tokens of each text under a byte-level BPE of ranks; vocabulary is a file of base64 pieces and ranks
    that the driver reads. The vocabulary's size is that of the file, some MB, so it is broadcast."""
    import base64

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern = held.value
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(bpe.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens bigint")


def _words(separator: str) -> Column:
    w = F.split(F.col("text"), separator, -1)
    n = F.size(w)
    return n - (F.get(w, F.lit(0)) == "").cast("int") - F.when((n > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents are inserted as words between white space; every tenth is then deleted and comes back in the last batch, and of the
    others every seventh is recounted as runs of letters, digits and other characters from \\x80. The second batch arrives twice. In
    the end every document is counted once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    old, new = _words(r"[\x20\x09-\x0D]+"), _words(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    spaced, plain = F.lit("spaced-1"), F.lit("plain-2")
    gone, again = docs.where("doc_id % 10 = 3"), docs.where("doc_id % 10 <> 3 AND doc_id % 7 = 1")
    rollup = Rollup(spark, shared_dir(spark))
    rollup.commit("inserted", changes(docs, 1, version=spaced, tokens=old))
    for _ in range(2):
        rollup.commit("deleted", changes(gone, -1, version=spaced, tokens=old))
    rollup.commit("revised", changes(again, -1, version=spaced, tokens=old).union(changes(again, 1, version=plain, tokens=new)))
    rollup.compact("sum-1")
    rollup.commit("again", changes(gone, 1, version=spaced, tokens=old))
    return rollup.totals()


ORACLE_SQL = r"""
WITH d AS (
  SELECT source, lang, doc_id % 7 = 1 AND doc_id % 10 <> 3 AS plain, text FROM documents
), t AS (
  SELECT source, lang, CASE WHEN plain THEN 'plain-2' ELSE 'spaced-1' END AS version,
         CASE WHEN plain THEN len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS tokens FROM d
)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS docs, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM t GROUP BY source, lang, version
"""
