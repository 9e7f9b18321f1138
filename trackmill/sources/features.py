"""Objects of large JSON documents, read in parts by many tasks.

A document such as a FeatureCollection is one value and often one line, so it has no place where a reader could begin. The text
source can split a file at any character, here at closing braces; what a part does not know is whether it
begins inside a string and how deep. Both follow from the parts before it, and each part is a fixed change of
them: one scan sums up each part (does it change between inside and outside, and how much deeper does it lead from either), a
row a part, from which the driver works out where all parts begin. A second scan cuts out the objects. An
object that goes on in other parts comes in fragments, one or two a part, which are put together by part.

All bytes are read by Spark's own reader, from any file system that it knows; memory is that of a batch and of the largest object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PART = "file string, start long"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start of the part, and the text up to each closing brace, in order within a part."""
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _scanned(buf, inside: bool):
    """Places of the brackets outside of strings (given whether the text begins inside one), and whether it ends inside one."""
    import numpy as np

    quotes = np.flatnonzero(buf == 34)
    # a quote behind an odd number of backslashes is none; a piece never begins with one that is
    behind = quotes[(quotes > 0) & (buf[np.maximum(quotes - 1, 0)] == 92)]
    escaped = []
    for q in behind.tolist():
        n = q
        while n and buf[n - 1] == 92:
            n -= 1
        if (q - n) % 2:
            escaped.append(q)
    quotes = quotes[~np.isin(quotes, escaped)] if escaped else quotes
    at = np.flatnonzero((buf == 123) | (buf == 125) | (buf == 91) | (buf == 93))
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    return at, outside, bool((len(quotes) + inside) % 2)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], object]]:
    """Part and bytes, for each run of pieces of one part."""
    import numpy as np

    for batch in batches:
        files, starts, texts = (batch.column(i).to_pylist() for i in range(3))
        a = 0
        while a < len(texts):
            b = a
            while b < len(texts) and (files[b], starts[b]) == (files[a], starts[a]):
                b += 1
            yield (files[a], starts[a]), np.frombuffer(("}".join(texts[a:b]) + "}").encode(), np.uint8)
            a = b


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: whether strings are open at its end if they were not at its beginning, and the change of depth from outside and from inside."""
    import numpy as np

    found: dict[tuple[str, int], list] = {}
    for part, buf in _runs(batches):
        flip, out, in_ = found.setdefault(part, [False, 0, 0])
        at, outside, flip_now = _scanned(buf, flip)
        step = np.where((buf[at] == 123) | (buf[at] == 91), 1, -1)
        found[part] = [flip_now, out + int(step[outside].sum()), in_ + int(step[~outside].sum())]
    columns = [[k[0] for k in found], [k[1] for k in found], *([v[i] for v in found.values()] for i in range(3))]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "flip", "out", "in"])


def _objects(begins, depth: int):
    """Objects at that depth. at is the place of an object in its part, -1 for one that goes on from another part; whole tells whether it ends here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = json.loads(begins.value)
        part, inside, level, n, held = None, False, 0, 0, []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "at", "whole", "value"])

        def left() -> list[tuple]:
            """What a part ends with, if an object goes on."""
            return [(*part, n, False, b"".join(held).decode())] if part and level > depth and held else []

        for here, buf in _runs(batches):
            out = []
            if here != part:
                out += left()
                part, (inside, level), n, held = here, known[here[0]][str(here[1])], 0, []
                n = -1 if level > depth else 0
            at, outside, inside = _scanned(buf, inside)
            at = at[outside]
            levels = level + np.cumsum(np.where((buf[at] == 123) | (buf[at] == 91), 1, -1))
            opens = at[(buf[at] == 123) & (levels == depth + 1)]
            closes = at[(buf[at] == 125) & (levels == depth)]
            if level > depth:
                opens = np.r_[0, opens]
            for i, a in enumerate(opens.tolist()):
                end = int(closes[i]) + 1 if i < len(closes) else len(buf)
                held.append(buf[a:end].tobytes())
                if i < len(closes):
                    out.append((*part, n, True, b"".join(held).decode()))
                    n, held = max(n, 0) + 1, []
            level = int(levels[-1]) if len(levels) else level
            yield rows(out)
        yield rows(left())

    return run


def objects(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """file, start, at (an object's part and place there, an order within the file) and value, the text of each object inside so many brackets: 2 for the members of an array in the document's own object."""
    pieces = _pieces(spark, path)
    begins: dict[str, dict[str, tuple[bool, int]]] = {}
    last: dict[str, tuple[bool, int]] = {}
    # a row a part, which is a hundred megabytes or more of a large file
    for r in pieces.mapInArrow(_changes, _PART + ", flip boolean, out long, in long").orderBy("file", "start").toLocalIterator():
        inside, level = last.get(r.file, (False, 0))
        begins.setdefault(r.file, {})[str(r.start)] = inside, level
        last[r.file] = inside != r.flip, level + (r["in"] if inside else r.out)
    found = pieces.mapInArrow(_objects(spark.sparkContext.broadcast(json.dumps(begins)), depth), _PART + ", at long, whole boolean, value string")
    cut = found.where("at < 0 OR NOT whole")
    # fragments go to the part in which their object began
    began = F.last(F.when(F.col("at") >= 0, F.col("start")), True).over(Window.partitionBy("file").orderBy("start", "at"))
    joined = cut.withColumn("began", began).groupBy("file", "began").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("p"))
    joined = joined.select("file", F.col("began").alias("start"), F.get("p", F.lit(0))["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    return found.where("at >= 0 AND whole").select("file", "start", "at", "value").unionByName(joined)
