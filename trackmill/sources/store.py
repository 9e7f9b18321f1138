"""Tables that grow by whole batches, each of which counts once.

A batch is written to a folder of its own, under a name that no other attempt has, and counts from the moment its
commit exists: a small file that names the folders, put in its place by one rename. So all
tables of a batch appear together or not at all, an attempt that died leaves nothing that is read, and committing an id again
does nothing. Readers take the folders that commits name; commits are numbered in the order in which
they were made.

Batches are committed by one writer at a time: of two that race for one id the first rename wins, but two batches that are
new at the same time cannot see each other's keys.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Ids in the order of their commits."""
        return [c["batch"] for c in self._commits()]

    def _commits(self) -> list[dict]:
        where = self._path(f"{self.folder}/commits")
        if not self._fs.exists(where):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(where)]
        found = []
        for name in sorted(n for n in names if n.endswith(".json")):
            stream = self._fs.open(self._path(f"{self.folder}/commits/{name}"))
            try:
                found.append(json.loads(bytes(stream.readAllBytes())))
            finally:
                stream.close()
        return sorted(found, key=lambda c: (c["number"], c["batch"]))

    def _rows(self, table: str, folders: list[str], schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data/{table}").parquet(*[f"{self.folder}/data/{table}/{f}" for f in folders]).drop("batch")

    def read(self, table: str, schema: T.StructType | str) -> DataFrame:
        """The committed rows of a table, with those columns; none if there is nothing yet."""
        folders: list[str] = []
        for c in self._commits():
            folders = [*([] if c["replace"] else folders), *([c["tables"][table]] if table in c["tables"] else [])]
        return self._rows(table, folders, schema) if folders else self.spark.createDataFrame([], schema)

    def stage(self, table: str, rows: DataFrame, by: list[str] | None = None) -> str:
        """Writes rows (in folders named by some columns) where nobody reads them yet; the folder's name is for commit()."""
        folder = f"batch={uuid.uuid4().hex}"
        rows.write.partitionBy(*(by or [])).parquet(f"{self.folder}/data/{table}/{folder}")
        return folder

    def staged(self, table: str, folder: str, schema: T.StructType | str) -> DataFrame:
        return self._rows(table, [folder], schema)

    def commit(self, batch: str, tables: dict[str, str], replace: bool = False) -> bool:
        """Makes staged folders count, all at once (and those of the batches before no longer, if they are to be replaced); whether the batch was new."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch id is letters, digits, dots, - and _")
        done, ready = self._path(f"{self.folder}/commits/{batch}.json"), self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        number = max([c["number"] for c in self._commits()], default=0) + 1
        stream = self._fs.create(ready)
        stream.write(bytearray(json.dumps({"batch": batch, "number": number, "tables": tables, "replace": replace}).encode()))
        stream.close()
        won = not self._fs.exists(done) and self._fs.rename(ready, done)
        if not won:
            self._fs.delete(ready, False)
        return won

    def append(self, batch: str, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None, replace: bool = False) -> bool:
        """Stages and commits a batch, unless it has been committed; whether it was new. by: the columns that a table's folders are named by."""
        if batch in self.batches():
            return False
        return self.commit(batch, {name: self.stage(name, rows, (by or {}).get(name)) for name, rows in tables.items()}, replace)


def unique(rows: DataFrame, keys: list[str], best: list[str]) -> DataFrame:
    """One row a key: the one with the greatest `best` columns, then by its other plain columns. Null keys are equal."""
    rest = [f.name for f in rows.schema if f.name not in (*keys, *best) and isinstance(f.dataType, T.AtomicType)]
    order = F.struct(*[F.col(c) for c in (*best, *rest)])
    one = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return one.select("_row.*")
