"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the smallest fingerprint of
its GRAM-word runs, so equal windows have equal minimisers wherever they stand. Consecutive windows
that share a minimiser travel as one packed string (their common stretch of text) to the bucket of
that minimiser; a word is sent some three times instead of WINDOW times. In a bucket all windows
are fingerprinted with 128 bits and sorted: equal ones are then neighbours, and those of a document
above the run's smallest doc_id are removed.

Hot passages: runs that are frequent in a sample of the documents are minimisers only of windows that hold
no other run. (Any order of the runs gives the same result; this one says where windows travel.) Windows on
the border of a hot passage so go to buckets of their rare words, and those inside are equal super-k-mers in
all documents. Equal super-k-mers meet in the scanning task first: all but the one with the smallest doc_id
are decided there, since a smaller document with those windows is known, and only that one travels.
A passage in a third of all documents so reaches its bucket once for each FLUSH bytes of text; a task
that reads a large bucket combines equal ones again before it goes on. The number of buckets grows with the text.

Defined cases: null and short texts have no window; a repeat within one document is no repeat;
rows that share a doc_id do not remove from each other; rows without doc_id neither remove nor lose
words; a doc_id that is no whole number is refused; an empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, WORDS, WORDS2, Words, chunks, cut, parts, save, scratch, spread, trim, whole_ids

WINDOW = 50
GRAM = 6
#: bytes of text whose super-k-mers are held, combined and sent together
FLUSH = 12 << 20
#: packed bytes of a bucket that are sorted together
SLAB = 32 << 20
_U = np.uint64
#: the low bits of a minimiser hold its place, so that each occurrence differs
_PLACE = _U((1 << 22) - 1)


#: one document in so many is looked at for hot runs; a run is hot from HOT_FROM times and this part of a bucket's mean on
SAMPLED, HOT_FROM, HOT_PART = 16, 64, 16
#: at most so many buckets for each shuffle partition
MOST_BUCKETS = 64
_LAST = _U(1 << 63)


class Hot:
    """Sorted fingerprints of runs that are to be minimisers last."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.seen = np.sort(keys), np.zeros(1 << 20, bool)
        self.seen[self.keys >> _U(44)] = True

    def mark(self, g: np.ndarray) -> np.ndarray:
        """g with these runs above all others."""
        out = g & ~_LAST
        some = np.flatnonzero(self.seen[g >> _U(44)]) if len(self.keys) else []
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, g[some]), len(self.keys) - 1)
            out[some[self.keys[at] == g[some]]] |= _LAST
        return out


def minimisers(h: np.ndarray, window: int, gram: int, hot: Hot | None = None) -> np.ndarray:
    """For each window of the word sequence, the smallest fingerprint of its runs of gram words, with its place."""
    g = WORDS.windows(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = g if hot is None else hot.mark(g)
    g = (g & ~_PLACE) | (np.arange(len(g), dtype=np.uint64) & _PLACE)
    span, have = window - gram + 1, 1
    while have * 2 <= span:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[:n], g[span - have : span - have + n])


class _Held:
    """Super-k-mers of some texts, until they are combined and sent."""

    def __init__(self, window: int, gram: int, n_buckets: int, hot: Hot | None):
        self.window, self.gram, self.n_buckets, self.hot = window, gram, n_buckets, hot
        self.clear()

    def clear(self) -> None:
        self.size, self.cols, self.text = 0, [], []

    def add(self, ids: np.ndarray, keys: np.ndarray, known: np.ndarray, buf: np.ndarray, off: np.ndarray) -> None:
        w = Words(buf, off, SPACED, False)
        self.size += len(buf)
        h = w.hashes()
        low = minimisers(h, self.window, self.gram, self.hot)
        text = w.text()
        ok = (w.left()[: len(low)] >= self.window) & known[text[: len(low)]]
        at = np.flatnonzero(ok)
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (low[at][1:] != low[at][:-1]) | (np.diff(at) != 1)
        first = at[new]
        count = np.diff(np.r_[np.flatnonzero(new), len(at)])
        last = first + count + self.window - 2
        d = text[first]
        sums, sums2 = WORDS.sums(h), WORDS2.sums(h)
        raw = memoryview(np.ascontiguousarray(buf))
        self.text += [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)]
        self.cols.append((((low[first] >> _U(22)) % _U(self.n_buckets)).astype(np.int32), ids[d], keys[d], first - w.first[d], count, WORDS.ranges(sums, first, last + 1), WORDS2.ranges(sums2, first, last + 1)))

    def sent(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): bucket -1 has what is decided here."""
        if not self.cols:
            return
        bucket, doc, key, at, count, h1, h2 = (np.concatenate(c) for c in zip(*self.cols, strict=True))
        order = np.lexsort((at, key, doc, h2, h1, bucket))
        b = bucket[order]
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1]) & (b[1:] == b[:-1])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        gone = doc[order] > doc[head]
        if gone.any():
            x = order[gone]
            yield -1, _packed(doc[x], key[x], at[x], count[x])
        stay = order[~gone]
        edges = cut(bucket[stay])
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            x = stay[a:e]
            yield int(bucket[x[0]]), _packed(doc[x], key[x], at[x], count[x], [self.text[i] for i in x.tolist()])


def _packed(doc, key, at, count, text=()) -> bytes:
    import zstandard

    raw = b"\n".join(text)
    sizes = np.array([len(t) for t in text], np.int32)
    parts_ = [np.array([len(doc), len(sizes)], np.int64), doc.astype(np.int64), key.astype(np.int64), at.astype(np.int32), count.astype(np.int32), sizes]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts_) + raw)


def _unpacked(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, k in (("i8", n), ("i8", n), ("i4", n), ("i4", n), ("i4", m)):
        out.append(np.frombuffer(raw, kind, int(k), at))
        at += int(k) * np.dtype(kind).itemsize
    return *out, np.frombuffer(raw, np.uint8, offset=at)


def _counted(gram: int):
    """Runs that a task meets more than once in FLUSH bytes of text, how often, and (without a run) how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            edges = cut(x)
            times = np.diff(edges)
            some = np.flatnonzero(times > 1)
            return pa.RecordBatch.from_arrays([pa.array([*x[edges[some]].view(np.int64).tolist(), None], pa.int64()), pa.array([*times[some].tolist(), len(x)], pa.int64())], names=["x", "n"])

        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                w = Words(buf, off, SPACED, False)
                g = WORDS.windows(w.hashes(), gram)
                held.append(g[w.left()[: len(g)] >= gram])
                size += len(buf)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
                    trim()
        yield out()
        trim()

    return run


def hot_runs(rows: DataFrame, gram: int, n_buckets: int) -> np.ndarray:
    """Runs that hold more of the sampled documents' runs than 1 / (HOT_PART * n_buckets), of which there are at most as many."""
    counts = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_counted(gram), "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))
    with scratch(rows.sparkSession):
        counts = save(counts)
        total = counts.where("x IS NULL").first()
        least = max(HOT_FROM, (total.n if total else 0) // (HOT_PART * n_buckets))
        keys = np.asarray(counts.where((F.col("n") >= least) & F.col("x").isNotNull()).select("x").toArrow()["x"], np.int64)
    return keys.view(np.uint64)


def _send(window: int, gram: int, n_buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(window, gram, n_buckets, Hot(hot.value))

        def out():
            sent = list(held.sent())
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in sent], pa.int32()), "blob": pa.array([x[1] for x in sent], pa.binary())})

        for batch in batches:
            known = ~np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            keys = np.asarray(batch.column(1))
            for a, b, buf, off in chunks(batch.column(2)):
                held.add(ids[a:b], keys[a:b], known[a:b], buf, off)
                if held.size >= FLUSH:
                    yield out()
                    trim()
        yield out()
        trim()

    return run


def _runs(doc, key, at, gone) -> pa.RecordBatch:
    """Neighbouring windows that go, as runs."""
    x = np.flatnonzero(gone)
    x = x[np.lexsort((at[x], key[x], doc[x]))]
    d, k, p = doc[x], key[x], at[x]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] > p[:-1] + 1)
    i = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(d[i], pa.int64()), pa.array(k[i], pa.int64()), pa.array(p[i], pa.int32()), pa.array(p[np.r_[i[1:], len(x)] - 1] - p[i] + 1, pa.int32()) if len(i) else pa.array([], pa.int32())], names=["doc", "key", "at", "count"])


def _windows(blob: bytes, window: int, slab: int, slabs: int) -> tuple[np.ndarray, ...]:
    """Fingerprints, document, text and place of a blob's windows that fall into one of the slabs."""
    doc, key, at, count, size, buf = _unpacked(blob)
    # texts end with their last word, so the joining byte is the first of the next range
    offsets = np.r_[0, np.cumsum(size.astype(np.int64) + 1)]
    offsets[-1] = len(buf)
    out, done = [], 0
    while done < len(doc):  # a stretch at a time, for memory
        b = max(done + 1, int(np.searchsorted(offsets, offsets[done] + (1 << 20), "right")) - 1)
        n = count[done:b]
        w = Words(buf[offsets[done] : offsets[b]], offsets[done : b + 1] - offsets[done], SPACED, False)
        h, step = w.hashes(), spread(n)
        i = np.repeat(w.first[:-1], n) + step
        h1 = WORDS.windows(h, window)[i]
        own = np.flatnonzero(h1 % _U(slabs) == _U(slab)) if slabs > 1 else slice(None)
        out.append((h1[own], WORDS2.windows(h, window)[i][own], *(x[own] for x in (np.repeat(doc[done:b], n), np.repeat(key[done:b], n), np.repeat(at[done:b], n) + step))))
        done = b
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _combined(blobs: list[bytes]) -> Iterator[bytes]:
    """The blobs of a bucket as one, in which equal super-k-mers stand once, with the smallest document; first what that decides."""
    least: dict[bytes, list[tuple]] = {}
    gone = []
    for blob in blobs:
        doc, key, at, count, size, buf = _unpacked(blob)
        ends = np.cumsum(size.astype(np.int64) + 1) - 1
        for d, k, a, n, s, e in zip(doc.tolist(), key.tolist(), at.tolist(), count.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
            own = least.setdefault(buf[s:e].tobytes(), [])
            if own and d < own[0][0]:
                gone += own
                own.clear()
            # a document's own repeats stay together: they do not remove each other, but a smaller document removes all
            (own if not own or d == own[0][0] else gone).append((d, k, a, n))
    columns = lambda rows: (np.array([x[i] for x in rows], np.int64) for i in range(4))
    yield _packed(*columns(gone))
    yield _packed(*columns([x for own in least.values() for x in own]), [t for t, own in least.items() for _ in own])


def _bucket(blobs: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of one bucket that also stand in a smaller document. A large bucket is sorted in slabs of its fingerprints."""
    slabs = 1 + sum(map(len, blobs)) // SLAB
    for slab in range(slabs):
        h1, h2, doc, key, at = (np.concatenate(c) for c in zip(*(_windows(b, window, slab, slabs) for b in blobs), strict=True))
        if not len(h1):
            continue
        order = np.argsort(h1)
        s1, s2 = h1[order], h2[order]
        equal = s1[1:] == s1[:-1]
        if (equal & (s2[1:] != s2[:-1])).any():
            order = np.lexsort((h2, h1))
            s1, s2 = h1[order], h2[order]
            equal = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
        head = np.flatnonzero(np.r_[True, ~equal])
        least = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.r_[head, len(order)]))
        gone = np.zeros(len(order), bool)
        gone[order] = doc[order] > least
        yield _runs(doc, key, at, gone)


def _decide(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, blobs, limit = None, [], SLAB

        def decided(blob: bytes) -> pa.RecordBatch:
            doc, key, at, count, *_ = _unpacked(blob)
            return _runs(np.repeat(doc, count), np.repeat(key, count), np.repeat(at, count) + spread(count), np.ones(int(count.sum()), bool))

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    yield decided(blob.as_py())
                    continue
                if bucket != here and blobs:
                    yield from _bucket(blobs, window)
                    blobs, limit = [], SLAB
                    trim()
                here = bucket
                blobs.append(blob.as_py())
                if sum(map(len, blobs)) > limit:
                    gone, rest = _combined(blobs)
                    yield decided(gone)
                    blobs = [rest]
                    limit = max(SLAB, 2 * len(rest))
                    trim()
        if blobs:
            yield from _bucket(blobs, window)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, key, runs: the windows of a row (named by doc_id and the text's hash) that stand in a smaller document too, as runs of start and count."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    whole_ids(docs)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(docs.sparkSession) * min(MOST_BUCKETS, max(4, -(-2 * size // (SLAB * parts(docs.sparkSession)))))
    hot = docs.sparkSession.sparkContext.broadcast(hot_runs(rows, gram, n))
    sent = rows.mapInArrow(_send(window, gram, n, hot), "bucket int, blob binary")
    # what is decided already is spread by itself
    where = F.when(F.col("bucket") < 0, F.xxhash64("blob") % n).otherwise(F.col("bucket")).alias("to")
    runs = sent.select("bucket", "blob", where).repartition(parts(docs.sparkSession), "to").sortWithinPartitions("bucket").select("bucket", "blob").mapInArrow(_decide(window), "doc long, key long, at int, count int")
    return runs.groupBy("doc", "key").agg(F.collect_list(F.struct("at", "count")).alias("runs"))


def _rest(window: int, n_cols: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts, found = batch.column(n_cols), batch.column(n_cols + 1)
            n_words, n_removed, sha, new = [], [], [], []
            for text, runs in zip(texts, found, strict=True):
                raw = text.as_py()
                words = raw.encode().split() if raw is not None else []
                n = len(words)
                if runs.is_valid:
                    mark = np.zeros(n + 1, np.int32)
                    r = runs.as_py()
                    np.add.at(mark, [x["at"] for x in r], 1)
                    np.add.at(mark, [x["at"] + x["count"] + window - 1 for x in r], -1)
                    keep = np.cumsum(mark)[:n] == 0
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                if whole:
                    new.append(raw if n == len(words) else kept.decode())
                else:
                    sha.append(hashlib.sha256(kept).hexdigest())
            last = pa.array(new, pa.string()) if whole else pa.array(sha, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], names=[*(f"c{i}" for i in range(n_cols)), "n_words", "n_removed", "last"])
        trim()

    return run


def _applied(docs: DataFrame, columns: list[str], window: int, gram: int, whole: bool) -> tuple[DataFrame, list[str]]:
    found = repeats(docs, window, gram)
    bare = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("k"))
    both = bare.join(found, (F.col("id") == F.col("doc")) & (F.col("k") == F.col("key")), "left")
    names = [f"c{i}" for i in range(len(columns))]
    plain = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("last", T.StringType())])
    return both.select(*names, "text", "runs").mapInArrow(_rest(window, len(columns), whole), plain), names


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the words that stay."""
    out, _ = _applied(docs, ["doc_id"], window, gram, False)
    return out.select(F.col("c0").alias("doc_id"), "n_words", "n_removed", F.col("last").alias("kept_sha256"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without repeated passages; a text that loses words is what stays, joined by one space (and n_chars its
    length, if there is such a column). A document that loses all its words goes."""
    out, names = _applied(docs, docs.columns, window, gram, True)
    new = {"text": F.col("last"), "n_chars": F.when(F.col("n_removed") > 0, F.length("last").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None)}
    cols = []
    for c, n in zip(docs.columns, names, strict=True):
        cols.append((F.coalesce(new[c], F.col(n)) if c == "n_chars" else new[c] if c == "text" else F.col(n)).alias(c))
    return out.where("n_removed = 0 OR n_removed < n_words").select(*cols)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: words by DuckDB's own pattern; windows as joined strings
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT doc_id, r, i, sha256(array_to_string(w[i : i + 49], ' ')) AS g
  FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), low AS (
  SELECT g, min(doc_id) AS least FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (g) WHERE doc_id > least
), kept AS (
  SELECT d.r, count(gone.p) AS n_removed, string_agg(d.x, ' ' ORDER BY d.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN gone ON d.r = gone.r AND d.p = gone.p GROUP BY d.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
