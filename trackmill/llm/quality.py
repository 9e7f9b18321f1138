"""Quality scores by co-training of a text view and a metadata view.

The text view sees hashed words and a few ratios (symbols, capitals, digits, distinct words, repeated
lines, word length); the metadata view sees source, language and size, hashed. Each is a logistic
classifier, trained in numpy on the driver from a bounded sample: about PER_LABEL rows of each label
and POOL unlabelled ones, drawn by a hash of the doc_id; executors make the views of their whole texts. In each
of ROUNDS rounds a view labels the pool rows it is surest of, in the labels' own proportion, for the
other view to learn from. A third of the labelled rows is kept out of that: on it each view
is calibrated (a logistic curve) and the two are combined (a logistic of both).

All documents are scored in one pass over whole texts without a shuffle; what is broadcast has a
fixed size.

Defined cases: a null text counts as empty; null metadata are values of their own; labels that are
null or without a document are not learned from; without labels of both kinds all scores are 0.5;
repeated rows get equal results; columns other than doc_id, text, source and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDLIKE, Words, chunks, trim

PER_LABEL = 1500
POOL = 3000
BUCKETS = 1 << 11
META = 1 << 9
ROUNDS = 5
SURE = 60
RATIOS = 8
STEPS = 60


def text_view(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of hashed words, and a row of ratios for each text."""
    n = len(off) - 1
    w = Words(buf, off, WORDLIKE, True)
    h = (w.hashes() >> np.uint64(40)) % np.uint64(BUCKETS)
    key, times = np.unique(w.text() * BUCKETS + h.astype(np.int64), return_counts=True)
    d, b = key // BUCKETS, key % BUCKETS
    v = np.sqrt(times)
    v = v / np.maximum(np.sqrt(np.bincount(d, v * v, minlength=n)), 1e-9)[d]
    size = np.maximum(np.diff(off), 1)
    share = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][off]) / size
    upper, digit, blank = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57), (buf == 32) | (buf == 10)
    symbol = (buf < 128) & ~upper & ~digit & ~blank & ~((buf >= 97) & (buf <= 122)) & (buf != 46) & (buf != 44)
    words = np.maximum(w.count, 1)
    repeat = np.zeros(len(w.start))
    if len(w.start) > 1:
        x = w.hashes()
        repeat[1:] = x[1:] == x[:-1]
    lines = np.zeros(n)
    for i in range(n):
        ls = [x for x in buf[off[i] : off[i + 1]].tobytes().split(b"\n") if x]
        lines[i] = 1 - len(set(ls)) / len(ls) if ls else 0
    ratios = np.stack([share(symbol) * 5, share(upper) * 2, share(digit) * 5, np.bincount(d, minlength=n) / words, np.bincount(w.text(), repeat, minlength=n) / words * 3, lines * 3, np.minimum(size / words / 8, 3), np.log1p(w.count) / 8], 1)
    return d, b, v, ratios


def meta_view(source: list, lang: list, size: np.ndarray) -> np.ndarray:
    """Four hashed features of each row."""
    import xxhash

    kinds = [("s", source), ("l", lang), ("n", np.log2(size + 1).astype(int).tolist()), ("x", list(zip(source, lang, strict=True)))]
    return np.array([[xxhash.xxh64_intdigest(f"{k}{v!r}") % META for v in values] for k, values in kinds], np.int64).T.reshape(-1, 4)


class _View:
    """A logistic classifier, trained by full gradient steps with momentum; each round goes on from the one before."""

    def __init__(self, width: int):
        self.w = np.zeros(width + 1, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        y = y.astype(np.float32)
        pace, rate = np.zeros_like(self.w), np.float32(4.0 / (1.0 + np.einsum("ij,ij->i", x, x).mean()))
        for _ in range(STEPS):
            miss = (_sigmoid(self.raw(x)) - y) / np.float32(len(y))
            g = np.r_[miss @ x, miss.sum()] + np.float32(1e-4) * self.w
            pace = np.float32(0.9) * pace - rate * g
            self.w += pace

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last a constant, by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dense(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of (buckets, weights, ratios, metadata) rows."""
    out, meta = np.zeros((len(rows), BUCKETS + RATIOS), np.float32), np.zeros((len(rows), META), np.float32)
    for i, (bucket, v, ratios, at) in enumerate(rows):
        out[i, bucket] = v
        out[i, BUCKETS:] = ratios
        np.add.at(meta[i], at, 1)
    return out, meta


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, text, source, lang) rows to key, label and packed views."""
    for batch in batches:
        out = []
        for a, b, buf, off in chunks(batch.column(2)):
            d, bucket, v, ratios = text_view(buf, off)
            edges = np.searchsorted(d, np.arange(b - a + 1))
            meta = meta_view(*(batch.column(i).slice(a, b - a).to_pylist() for i in (3, 4)), np.diff(off))
            for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                out.append(np.int64(e - s).tobytes() + bucket[s:e].astype(np.int32).tobytes() + v[s:e].astype(np.float32).tobytes() + ratios[i].astype(np.float32).tobytes() + meta[i].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "label", "views"])
        trim()


def _views(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int32, n, 8), np.frombuffer(blob, np.float32, n, 8 + 4 * n), np.frombuffer(blob, np.float32, RATIOS, 8 + 8 * n), np.frombuffer(blob, np.int32, -1, 8 + 8 * n + 4 * RATIOS)


def train(labelled: list[tuple], y: list[int], pool: list[tuple], share: dict[int, float], rounds: int = ROUNDS) -> dict:
    """labelled and pool: rows of both views, as _views() gives them; share: which part of each label's rows was drawn."""
    y = np.array(y, np.float64)
    if len(y) < 6 or y.min() == y.max():
        return {"text": np.zeros(BUCKETS + RATIOS + 1), "meta": np.zeros(META + 1), "curves": [(1.0, 0.0)] * 2, "both": np.zeros(3)}
    views, free = _dense(labelled), _dense(pool)
    kept_out = np.arange(len(y)) % 3 == 0
    models = [_View(BUCKETS + RATIOS), _View(META)]
    extra: list[dict[int, int]] = [{}, {}]
    rate = float(y.mean())
    for r in range(rounds + 1):
        for m, x, u, e in zip(models, views, free, extra, strict=True):
            at = np.array(sorted(e), np.int64)
            m.fit(np.vstack([x[~kept_out], u[at]]), np.r_[y[~kept_out], [e[i] for i in at.tolist()]])
        if r == rounds or not len(pool):
            break
        for m, u, other in zip(models, free, reversed(extra), strict=True):
            z = m.raw(u)
            new = [i for i in np.argsort(-z, kind="stable").tolist() if i not in other and z[i] > 0][: round(SURE * rate)]
            low = [i for i in np.argsort(z, kind="stable").tolist() if i not in other and z[i] < 0][: round(SURE * (1 - rate))]
            other.update({i: 1 for i in new} | {i: 0 for i in low})
    # the labels' own frequencies return with the constants
    shift = np.log(share.get(0, 1.0) / share.get(1, 1.0))
    curves, z = [], []
    for m, x in zip(models, views, strict=True):
        raw = m.raw(x[kept_out])
        a, b = _logistic(raw[:, None], y[kept_out])
        curves.append((float(a), float(b)))
        z.append(a * raw + b)
    both = _logistic(np.stack(z, 1), y[kept_out])
    both[-1] += shift
    return {"text": models[0].w.astype(float), "meta": models[1].w.astype(float), "curves": curves, "both": both}


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = [np.zeros((0, 3))]
            for a, b, buf, off in chunks(batch.column(1)):
                d, bucket, v, ratios = text_view(buf, off)
                zt = np.bincount(d, v * m["text"][bucket], minlength=b - a) + ratios @ m["text"][BUCKETS:-1] + m["text"][-1]
                source, lang = (batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3))
                zm = m["meta"][meta_view(source, lang, np.diff(off))].sum(1) + m["meta"][-1]
                zt, zm = (c[0] * z + c[1] for c, z in zip(m["curves"], (zt, zm), strict=True))
                out.append(np.stack([_sigmoid(m["both"][0] * zt + m["both"][1] * zm + m["both"][2]), _sigmoid(zt), _sigmoid(zm)], 1))
            x = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(3))], names=["doc_id", "score", "text_score", "meta_score"])
            trim()

    return run


def fitted(docs: DataFrame, labels: DataFrame, may_learn: Column) -> dict:
    marked = labels.select("doc_id", "quality").where(may_learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    share = {k: min(1.0, PER_LABEL / n) for k, n in counts.items()}
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)).cast("double") / float(1 << 20)
    chosen = marked.where(draw(23) < F.when(F.col("quality") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))).limit(4 * PER_LABEL)
    rows = _rows(docs).withColumn("key", F.xxhash64("doc_id"))
    kind = "key long, label int, views binary"
    marked_rows = rows.join(F.broadcast(chosen), "doc_id").select("key", F.col("quality").alias("label"), "text", "source", "lang")
    got = sorted({(r.key, r.label, bytes(r.views)) for r in marked_rows.mapInArrow(_viewed, kind).limit(8 * PER_LABEL).collect()})
    total = docs.count()
    # labelled ones among them do no harm: their labels are not used
    pool = rows.where(may_learn & (draw(29) < min(1.0, POOL / max(1, total)))).select("key", F.lit(None).cast("int").alias("label"), "text", "source", "lang")
    free = sorted({(r.key, bytes(r.views)) for r in pool.mapInArrow(_viewed, kind).limit(2 * POOL).collect()})
    return train([_views(g[2]) for g in got], [g[1] for g in got], [_views(g[1]) for g in free], share)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, and what each view alone gives."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return _rows(docs).mapInArrow(_scored(held), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, text_score double, meta_score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, fitted(docs, labels, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
