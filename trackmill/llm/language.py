"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's features are the byte trigrams and 4-grams of its letters, hashed into BUCKETS embeddings
each; their average goes through a linear softmax. Embeddings and softmax are trained by stochastic
gradient descent in numpy on the driver, on a bounded sample: about PER_LANGUAGE labelled documents of
each language (SAMPLE of all together at most), up to HELD_FEATURES features of each, drawn over its whole text
by the executors, so the driver sees no text. A step takes SAMPLED of them. A fifth of the sample calibrates: a
temperature for the probabilities, and the rejection threshold, below which REJECTED of the
correctly named documents lie (at most MOST_REJECTED_AT, at least OVER_CHANCE times the 1/L that the best of L languages always has).

Scoring is one pass over the texts without a shuffle. As the average is linear, embeddings times
softmax weights are one small table, which is broadcast (its size is fixed by BUCKETS and DIM).

Defined cases: a text that is null or without letters is `und` with score 0 and rejected; so is
every text when nothing could be learned; repeated rows get equal results; rows without doc_id or
lang are predicted but not learned from; other columns pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, chunks, save, trim

BUCKETS = 1 << 14
DIM = 16
PER_LANGUAGE = 500
SAMPLE = 100_000
SAMPLED = 400
HELD_FEATURES = 1600
EPOCHS = 6
#: steps at least, which small samples repeat more often for
STEPS = 1000
RATE = 4.0
WIDEST = 50.0
MOST_REJECTED_AT = 0.5
REJECTED = 0.01
OVER_CHANCE = 1.2
UNKNOWN = "und"

_ALL = np.arange(256)
_LETTER = (((FOLD >= 97) & (FOLD <= 122)) | (_ALL >= 128))
_PLAIN = np.where(_LETTER, FOLD, 32).astype(np.uint8)


def _grams(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashed features of the trigrams, and of the 4-grams, of some texts."""
    if len(buf) < 3:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
    letter, plain = _LETTER[buf], _PLAIN[buf].astype(np.uint32)
    x = plain[:-2] | (plain[1:-1] << 8) | (plain[2:] << 16)
    inside = np.ones(len(x), bool)
    for back in (1, 2):
        at = off[1:-1] - back
        inside[at[(at >= 0) & (at < len(x))]] = False
    three = np.flatnonzero(inside & letter[1:-1])
    four = three[three + 3 < len(buf)]
    four = four[inside[np.minimum(four + 1, len(x) - 1)] & letter[four + 2]]
    h3 = (x[three] * np.uint32(2654435761)) >> np.uint32(18)
    h4 = ((x[four] + (plain[four + 3] << 24)) * np.uint32(2246822519)) >> np.uint32(18)
    return [(three, h3.astype(np.int64)), (four, h4.astype(np.int64) + BUCKETS)]


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of some texts, in order of place, and their borders."""
    (three, h3), (four, h4) = _grams(buf, off)
    at = np.r_[three, four]
    order = np.argsort(at, kind="stable")
    return np.r_[h3, h4][order], np.searchsorted(at[order], off)


def _sums(table: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's summed rows of the table, and its number of features."""
    n = len(off) - 1
    out, count = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    for at, h in _grams(buf, off):
        edges = np.searchsorted(at, off)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        if len(some):
            out[some] += np.add.reduceat(table[h], edges[:-1][some], axis=0)
            count += np.diff(edges)
    return out, count


def _letters(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train(bags: list[np.ndarray], langs: list[str], seed: int = 5) -> dict:
    """bags: features of each text. table (features by DIM or, if they are fewer, languages), weights, bias, temperature, threshold and the languages' names."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "table": np.zeros((2 * BUCKETS, 1), np.float32), "weights": None, "bias": np.zeros(1), "temperature": 1.0, "threshold": 0.0}
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, langs)
    whole, bags = bags, [rng.choice(h, SAMPLED) if len(h) > SAMPLED else h for h in bags]
    fit = np.flatnonzero([len(b) > 0 for b in bags])
    held = fit[rng.permutation(len(fit)) < len(fit) // 5]
    fit = np.setdiff1d(fit, held)
    e = rng.normal(0, 0.1, (2 * BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    size, done = 16, 0
    epochs = max(EPOCHS, -(-STEPS * size // max(1, len(fit))))
    steps = epochs * -(-len(fit) // size)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), size):
            at = order[lo : lo + size]
            n = np.array([len(bags[i]) for i in at])
            h, of = np.concatenate([bags[i] for i in at]).astype(np.int64), np.repeat(np.arange(len(at)), n)
            mean = np.add.reduceat(e[h], np.cumsum(n) - n, axis=0) / n[:, None]
            p = _softmax(mean @ w + bias)
            p[np.arange(len(at)), y[at]] -= 1
            rate = RATE * (1 - done / steps) + 0.05
            grad = p @ w.T / n[:, None]
            # texts that cannot be told apart would drive the weights without end
            w = np.clip(w - rate * mean.T @ p / len(at), -WIDEST, WIDEST)
            bias -= 0.1 * rate * p.mean(0)
            np.subtract.at(e, h, rate * grad[of])
            done += 1
    small = len(names) <= DIM
    model = {"names": names, "table": (e @ w if small else e).astype(np.float32), "weights": None if small else w, "bias": bias, "temperature": 1.0, "threshold": 0.0}
    if len(held):
        z = np.stack([(e[whole[i].astype(np.int64)].mean(0)) @ w + bias for i in held])
        best = min(np.geomspace(0.2, 5, 40), key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean())
        p = _softmax(z / best)
        right = p.argmax(1) == y[held]
        model |= {"temperature": float(best), "threshold": _threshold(p.max(1)[right], len(names))}
    return model


def _threshold(right: np.ndarray, n: int) -> float:
    """The REJECTED quantile of these probabilities of the best of n languages, within its bounds."""
    at = min(MOST_REJECTED_AT, float(np.quantile(right, REJECTED))) if len(right) else MOST_REJECTED_AT
    return max(at, OVER_CHANCE / n) if n > 1 else at


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _logits(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums, n = _sums(model["table"], buf, off)
    mean = sums / np.maximum(n, 1)[:, None]
    return (mean if model["weights"] is None else mean @ model["weights"]) + model["bias"]


def _predict(model, n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array(m["names"] or [UNKNOWN], object)
        for batch in batches:
            lang, score, good = [], [], []
            texts = batch.column(n_cols)
            for a, b, buf, off in chunks(texts):
                p = _softmax(_logits(m, buf, off) / m["temperature"])
                ascii_ = _LETTER[buf] & (buf < 128)
                known = np.diff(np.r_[0, np.cumsum(ascii_)][off]) > 0
                for i in np.flatnonzero(~known).tolist():
                    known[i] = _letters(texts[a + i].as_py())
                known &= bool(m["names"])
                best = p.argmax(1)
                s = np.where(known, p[np.arange(b - a), best], 0.0)
                lang += np.where(known, names[best], UNKNOWN).tolist()
                score.append(s)
                good.append(known & (s >= m["threshold"]))
            out = [pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(np.concatenate(good) if good else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.StructArray.from_arrays(out, names=["lang", "score", "accepted"])], names=[*(f"c{i}" for i in range(n_cols)), "found"])
            trim()

    return run


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to HELD_FEATURES features of each text, drawn over all of it."""
    for batch in batches:
        out, keys = [], batch.column(0).to_pylist()
        for a, _, buf, off in chunks(batch.column(2)):
            h, edges = features(buf, off)
            for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                bag = h[s:e] if e - s <= HELD_FEATURES else np.random.default_rng(keys[a + i] & 0xFFFFFFFF).choice(h[s:e], HELD_FEATURES)
                out.append(bag.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "lang", "bag"])
        trim()


def sample(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> tuple[list[np.ndarray], list[str]]:
    """Features and language of about so many texts of each language (of all together SAMPLE at most), chosen by a hash of the doc_id. Executors cut the texts."""
    rows = docs.where(may_learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = save(rows.groupBy("lang").count())
    n = counts.count()
    if not n:
        return [], []
    per = max(1, min(per_language, SAMPLE // n))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(per)) / F.col("count")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)).cast("double") / float(1 << 20)
    chosen = rows.select(F.xxhash64("doc_id").alias("key"), F.col("lang").cast("string").alias("lang"), "text", drawn.alias("drawn")).join(share, "lang").where("drawn < share").select("key", "lang", "text")
    got = sorted((r.key, r.lang, bytes(r.bag)) for r in chosen.mapInArrow(_bagged, "key long, lang string, bag binary").limit(2 * per * n).collect())
    return [np.frombuffer(g[2], np.uint16) for g in got], [g[1] for g in got]


def identify(docs: DataFrame, model: dict, columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (all, by default) and found: lang, score and whether it is accepted."""
    columns = docs.columns if columns is None else columns
    bare = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    plain = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)] + [T.StructField("found", T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]))])
    out = bare.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), len(columns)), plain)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "found")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> dict:
    return train(*sample(docs.select("doc_id", "text", "lang"), ~held_out()))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known well enough, unchanged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return identify(rows, fitted(docs), ["row"]).where("found.accepted").select("row.*")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fitted(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.accepted").alias("accepted"))
