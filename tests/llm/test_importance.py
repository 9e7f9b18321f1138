import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests import duck
from tests.llm.brute import plain
from trackmill.llm import importance
from trackmill.llm.common import WORDLIKE, Words, strings


def grams(text, depth=3):
    w = plain(text)
    return [" ".join(w[i : i + k]) for k in range(1, depth + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in rows for f in grams(x)) for rows in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in grams(x))
        rows.append((d, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(able) // 100
    return sorted([(*r[:4], None) for r in rows if not r[4]] + [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)], key=str)


def made(rng):
    words = [*(f"w{i}" for i in range(40)), "é", "日本語", "x" * 63, "y" * 64, "z" * 500, "A", "Zz9"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(300)] + [(300, None), (301, "..."), (302, text(9000)), (None, text(30)), (None, None)]
    return rows + rows[40:80] + [rows[5]] * 50, [text(12) for _ in range(9)] + [None, "", "w1"]


def test_tries_hold_counts_crc_states_and_path_sums():
    rng = random.Random(1)
    texts = [t for _, t in made(rng)[0]]
    trie = importance.Trie(Words(*strings(pa.array(texts, pa.large_string())), WORDLIKE, True), importance._tables())
    want = Counter(zlib.crc32(f.encode()) for t in texts for f in grams(t))
    got = Counter()
    for count, state in trie.levels:
        for c, x in zip(count.tolist(), state.tolist(), strict=True):
            got[x] += c
    assert got == want
    gain = np.array([rng.randrange(-5000, 5000) for _ in range(97)])
    assert trie.weights(gain).tolist() == [int(sum(gain[zlib.crc32(f.encode()) % 97] for f in grams(t))) for t in texts]


@pytest.mark.parametrize("size", [importance.TRIE, 500])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(importance, "TRIE", size)
    docs, target = made(random.Random(2))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).selectExpr("*", "1 AS open", "'a' AS score", "2 AS at", "3 AS own", "4 AS c0", "5 AS weight")
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), percent=20).drop("n_words")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, 20)


def test_empty_inputs(spark):
    docs, none = spark.createDataFrame([(1, "a b " * 20)], "doc_id int, text string"), spark.createDataFrame([], "doc_id int, text string")
    assert importance.resample(none, docs).collect() == []
    r = importance.resample(docs, none.select("text"), percent=100).collect()
    assert [(x.doc_id, x.n_features, x.rank) for x in r] == [(1, 117, 1)]
    with pytest.raises(TypeError):
        importance.resample(docs.selectExpr("'x' AS doc_id", "text"), docs)


def test_query_equals_sql(spark, small):
    duck.assert_same(importance.op11_importance_resampling(spark, small), duck.connect(small), importance.ORACLE_SQL)
