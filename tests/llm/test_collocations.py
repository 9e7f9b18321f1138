import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import duck
from tests.llm.brute import FOLD
from trackmill.llm import collocations as co


def brute(docs, least=30, top=2000, cover=80):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    able = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    covered = set()
    for (lang, w), c in able.items():
        for k in range(2, len(w)):
            covered |= {s for i in range(len(w) - k + 1) if 100 * c >= cover * able[s := (lang, w[i : i + k])]}
    rows = {}
    for (lang, w), a in able.items():
        if (lang, w) not in covered:
            s, _, left, right = min((2_000_000 * a // (f[lang, w[:j]] + f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]]) for j in range(1, len(w)))
            rows.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def made(seed):
    rng = random.Random(seed)
    words, langs = ["a", "B", "the", "of", "é", "日本", "x y", "\x1f", "W" * 300, *(f"w{i}" for i in range(25))], ["en", "de", None, "und", ""]
    known = [[rng.choice(words) for _ in range(rng.randrange(2, 7))] for _ in range(12)]
    text = lambda n: "".join(rng.choice([" ".join(rng.choice(known)), rng.choice(words)]) + rng.choice([" ", " ", "\t ", ". ", ",", "\n", " ! "]) for _ in range(n))
    docs = [(rng.choice(langs), text(rng.randrange(60))) for _ in range(250)] + [("en", None), (None, ""), ("xx", " . \n"), ("fr", "one two three four five " * 4000)]
    return docs + docs[:30] * 3


@pytest.mark.parametrize("block, chunk", [(co.BLOCK, 1 << 20), (40, 2000)])
def test_against_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(co, "SHARD", 16 if block == 40 else co.SHARD)
    monkeypatch.setattr(co, "SLOTS", 8 if block == 40 else co.SLOTS)
    monkeypatch.setattr(co, "HELD", chunk)
    monkeypatch.setattr(co, "TOLD", chunk)
    docs = made(5)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5).selectExpr("*", "1 AS x", "2 AS score", "3 AS n", "4 AS phrase", "5 AS doc_id", "6 AS a")
    got = co.collocations(df, block=block, top=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(docs, top=25)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "FEWEST_BITS", 3 + 3)
    monkeypatch.setattr(co, "MOST_BITS", 6)
    monkeypatch.setattr(co, "SLICE_BITS", 4)
    docs = made(6)[:120]
    got = co.collocations(spark.createDataFrame(docs, "lang string, text string"), least=4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(docs, 4)


def test_the_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 5000, np.uint64)
    shard = x >> np.uint64(61)
    levels = [[(bits, x[np.flatnonzero(shard == s)[own]]) for bits, own in co.shard_levels(x[shard == s])] for s in range(8)]
    slots = co.Slots(0, 61, levels)
    assert sorted(slots.of(x).tolist()) == list(range(5000))
    assert (slots.of(rng.integers(0, 1 << 64, 5000, np.uint64)) == -1).all()
    part = co.Slots(2, 61, levels[2:5])
    mine = (shard >= 2) & (shard < 5)
    got = part.of(x)
    assert (got[~mine] == -1).all() and sorted(got[mine].tolist()) == list(range(int(mine.sum())))
    bits = sum(len(b) * 64 for s in levels for b, _ in s)
    assert bits < 6 * len(x)


def test_scores_are_exact(spark):
    rows = [(9_000_000_000_000_000_000, 9_100_000_000_000_000_001, 3), (30, 61, 0), (7, 7, 7)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", co.score(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [2_000_000 * a // (b + c) for a, b, c in rows]


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_query_equals_sql(spark, small):
    duck.assert_same(co.op12_collocations(spark, small), duck.connect(small), co.ORACLE_SQL)
