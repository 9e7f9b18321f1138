import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import ODD, prose
from trackmill.llm import substrings
from trackmill.llm.common import SPACED, Words, strings


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n, 50) for n in (12, 30, 75)]
    out = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 60), 50)
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        out.append((i // 2 if i < 20 else i, rng.choice([" ", "\n", "  "]).join(w)))
    return [*out, (200, out[5][1]), (201, "same " * 90), (202, "same " * 90)]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize(("window", "gram", "flush"), [(10, 3, 200), (10, 10, 10**7), (10, 1, 4000), (50, 6, 10**7)])
def test_equals_brute_force(spark, monkeypatch, window, gram, flush):
    monkeypatch.setattr(substrings, "FLUSH", flush)
    monkeypatch.setattr(substrings, "SLAB", 300 if flush == 4000 else 1 << 20)
    if flush < 10**7:  # so that some runs are hot
        for name in ("SAMPLED", "HOT_FROM"):
            monkeypatch.setattr(substrings, name, 1 if name == "SAMPLED" else 3)
    docs = corpus(window + gram)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(substrings.digest(df, window, gram)) == brute.digest(docs, window)


def test_hot_runs_come_last(spark, monkeypatch):
    """The windows of a passage that every document quotes: those inside share buckets, those on its border do not."""
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    rng = random.Random(2)
    passage = prose(rng, 30, 10**6)
    docs = [(i, " ".join(prose(rng, 20, 10**6) + passage + prose(rng, 20, 10**6))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hot = substrings.Hot(substrings.hot_runs(df, 3, 50))
    assert len(hot.keys) == 28
    words = Words(*strings(pa.array([docs[0][1]], pa.large_string())), SPACED, False)
    low = substrings.minimisers(words.hashes(), 10, 3, hot)
    last = [bool(x >> 63) for x in low.tolist()]
    assert last == [20 <= i <= 40 for i in range(len(low))]
    assert got(substrings.digest(df, 10, 3)) == brute.digest(docs, 10)


def test_equal_stretches_of_a_large_bucket_are_combined():
    blobs = [substrings._packed(np.array(d), np.array(d) + 100, np.array([3, 5]), np.array([1, 2]), texts) for d, texts in (([7, 9], [b"a b", b"c d e"]), ([2, 9], [b"a b", b"c d e"]), ([8, 1], [b"x y", b"c d e"]))]
    gone, rest = ([x.tolist() for x in substrings._unpacked(b)[:4]] for b in substrings._combined(blobs))
    assert sorted(zip(*gone)) == [(7, 107, 3, 1), (9, 109, 5, 2), (9, 109, 5, 2)]
    assert sorted(zip(*rest)) == [(1, 101, 5, 2), (2, 102, 3, 1), (8, 108, 3, 1)]


def test_odd_rows(odd, none):
    assert got(substrings.digest(odd)) == brute.digest([r[:2] for r in ODD])
    assert got(substrings.digest(none)) == [] and substrings.dedup(none).count() == 0
    kept = substrings.dedup(odd)
    assert kept.dtypes == odd.dtypes
    assert kept.count() == len(ODD) and kept.where("doc_id = 11").first().text == "end"
    assert kept.where("doc_id = 10").first().text == ODD[12][1] and kept.where("doc_id = 1").first().text is None


def test_new_lengths(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, len(long)), (2, f"a {long} b", 0), (3, "short", 5), (4, long, len(long))], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in substrings.dedup(df).collect()) == [(1, long, len(long)), (2, "a b", 3), (3, "short", 5)]
