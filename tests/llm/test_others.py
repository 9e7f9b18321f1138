import random
from collections import Counter

import numpy as np
import pytest

from tests.duck import assert_same, connect
from tests.llm import brute
from tests.llm.conftest import ODD, prose
from trackmill.llm import decontaminate, language, licenses, mixing, quality, queries, token_counts, topk, toxicity

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, small, name):
    assert_same(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name])


# ------------------------------------------------------------------ decontamination


def hits(df, **o):
    return sorted(((r.doc_id, r.hit.n_words, len(r.hit["words"]), list(r.hit["items"])) for r in df.collect()), key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (2, "short item"), (3, None), (4, "..."), (None, "nameless words here"), (10, "quick brown fox jumps over the lazy dog again and")]


@pytest.mark.parametrize("set_bytes", [decontaminate.SET_BYTES, 60])
def test_decontamination(spark, odd, none, set_bytes):
    rng = random.Random(1)
    docs = [(i, " ".join(prose(rng, 30) + (ITEMS[i % 7][1] or "").upper().split() + prose(rng, 5))) for i in range(40)] + [(99, "short"), (98, "the SHORT, item!")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    assert hits(decontaminate.scan(df, bench, columns=["doc_id"], set_bytes=set_bytes)) == brute.hits(docs, ITEMS)
    clean = {d for d, _, n, _ in brute.hits(docs, ITEMS) if not n}
    assert {r.doc_id for r in decontaminate.clean(df, bench, set_bytes=set_bytes).collect()} == clean
    assert hits(decontaminate.scan(decontaminate.remove_spans(df, bench), bench, columns=["doc_id"])) == sorted(((d, n - h, 0, []) for d, n, h, _ in brute.hits(docs, ITEMS)), key=str)
    assert hits(decontaminate.scan(odd, bench, columns=["doc_id"], set_bytes=set_bytes)) == brute.hits([r[:2] for r in ODD], ITEMS)
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.where("false")).count() == len(ODD)


# ------------------------------------------------------------------------ licenses


def test_licenses(spark, odd, none):
    texts = ["MIT License", "x (mit) license, Apache License; GNU general public license\nlicensed under CC BY-NC 4.0", "\nReleased, under the MIT license!", "the license of mit", "Licensed under CC BY-NC", "general public license general public license", "by nc cc 4 under 0 licensed", "limit license"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: ([(p.label, p.start) for p in r.places], sorted({m.label for m in r.matches or []})) for r in licenses.scan(df).collect()}
    assert got == {0: ([("mit", 0)], []), 1: ([("mit", 1), ("apache", 3), ("gpl", 6)], ["cc-by-nc"]), 2: ([("mit", 3)], ["mit"]), 3: ([], []), 4: ([], []), 5: ([("gpl", 0), ("gpl", 3)], []), 6: ([], ["cc-by-nc"]), 7: ([], [])}
    rows = licenses.scan(odd).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(brute.plain(r[1])) for r in ODD) and not any(r.places or r.matches for r in rows)
    assert licenses.scan(none).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n# 1. Redistributions",
    "isc": " * Permission to use, copy, modify, and/or distribute this software for any\r\n * purpose with or without fee is hereby granted, provided",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License as published by",
}


def test_wrapped_notices(spark):
    far = WRAPPED["isc"].replace("\r\n", " filler" * 40 + "\n")
    texts = [(label, f"first line\n\n{t}\nlast line of words") for label, t in WRAPPED.items()] + [(None, far), (None, "Redistribution and use in source\nand binary forms")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(t for _, t in texts)), DOCS)).collect()
    got = {r.doc_id: [(m.label, m.line, m.containment) for m in r.matches or []] for r in rows}
    assert got == {i: [(label, 2, 1.0)] if label else [] for i, (label, _) in enumerate(texts)}


def test_a_license_query_without_python(spark, small):
    for name in ("op3_license_scan", "op8_source_mixing"):
        plan = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------------- search


def best(rows, k, every):
    ok = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(ok):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SAMPLE", 60)
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "GROUP", 90)
    monkeypatch.setattr(topk, "PART", (1 << 16, 5, 3)[seed])
    rng = np.random.default_rng(seed)
    scale = rng.choice([0.1, 1.0, 9.0], 300)
    base = rng.normal(size=(6, 4 if seed else 16))
    v = (base[rng.integers(0, 6, 300)] + 0.05 * rng.normal(size=(300, base.shape[1]))) * scale[:, None]
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v.tolist())] + [(1000 + i, [1.0] * base.shape[1]) for i in range(60)]
    rows += [(2000, None), (2020, [None] * base.shape[1]), (2040, [float("nan")] * base.shape[1]), (2060, [float("inf")] * base.shape[1]), (2080, []), (2100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, df.vec_id % 20 == 0).collect())
    assert got == best(rows, 20, 20)


def test_top_k_of_repeated_ids(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = [(i % 50, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(120)]
    rows += [rows[0], rows[0], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in ("key", "group", "blob", "length", "rank", "score", "times")})
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()) == sorted(want)


def test_top_k_of_an_odd_long_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "WIDTH", 400)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3000 if i in (7, 20) else 4).astype(np.float32)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, df.vec_id % 20 == 0).collect())
    assert got == best(rows, 20, 20)
    with pytest.raises(TypeError):
        topk.search(df.selectExpr("CAST(vec_id AS STRING) AS vec_id", "embedding"), df.vec_id == 0)


def test_lengths_and_coordinates_prune():
    """Buckets of falling lengths, a few long vectors near each query."""
    rng = np.random.default_rng(3)
    p = np.floor(rng.normal(size=(8000, 24)) * np.repeat([400, 60, 50, 40, 8, 6, 4, 2], 1000)[:, None])
    p[:1000, 0] += 3000 * rng.choice([-1, 1], 1000)
    q = np.floor(rng.normal(size=(40, 24)) * 5)
    q[:, 0] += 400
    found = topk.Best(np.arange(-40, 0), q, 20, np.full(40, -np.inf))
    length = np.sqrt((p * p).sum(1))
    for a in range(0, 8000, 1000):
        order = a + np.argsort(-length[a : a + 1000], kind="stable")
        found.bucket(order, p[order], length[order])
    scores = q @ p.T
    for i in range(40):
        want = np.lexsort((np.arange(8000), -scores[i]))[:20]
        assert found.vec[found.of == i].tolist() == want.tolist()
    verified, multiplied, pairs = found.looked
    assert pairs == 40 * 8000 and verified + multiplied < 0.2 * pairs


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, df.vec_id % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.search(df.where("false"), df.vec_id % 20 == 0).count() == 0


# ------------------------------------------------------------------------- mixing


@pytest.mark.parametrize("few", [0, 10**5])
def test_mixing(spark, monkeypatch, odd, none, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rng = random.Random(few)
    docs = [(i, " ".join(prose(rng, rng.randrange(0, 40))), rng.choice(["a", "B", "c", "é", None, "hot", "hot", "hot", "hot"])) for i in range(900)]
    rows = mixing.plan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sizes, taken = {}, {}
    for d, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced(t))
    want, source = brute.targets(sizes), {d: s for d, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 0.25 * want[s] for s in sizes)
    out = mixing.mixture(odd)
    assert out.columns == odd.columns and mixing.mixture(none).count() == 0 and mixing.plan(none).count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixture(odd.repartition(3)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 1, None: 500}, {"a": 0, "b": 10}, {"a": 0}, {"only": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx({s: t for s, t in brute.targets(sizes).items()})


# ------------------------------------------------------------------- token counts


def test_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), (None, None, None)], "source string, lang string, t long")
    from pyspark.sql import functions as F

    change = lambda df, sign: token_counts.changes(df, sign, version=F.lit("v1"), tokens=F.col("t"))
    r = token_counts.Rollup(spark, str(tmp_path))
    assert r.totals().count() == 0
    assert r.commit("one", change(rows, 1)) and not r.commit("one", change(rows, 1)) and r.commit("none", change(rows.where("false"), 1))
    total = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    assert total() == [("a", "en", "v1", 2, 12), (None, None, "v1", 1, 0)]
    # a run that died before its marker leaves a delta that does not count
    change(rows, 1).groupBy(*token_counts.KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{tmp_path}/deltas/two")
    assert total()[0][3] == 2
    r.commit("two", change(rows.where("t = 7"), -1))
    r.compact("sum")
    assert total() == [("a", "en", "v1", 1, 5), (None, None, "v1", 1, 0)] and not r.commit("two", change(rows, 1))
    r.commit("three", change(rows.where("t = 5 OR t IS NULL"), -1))
    assert total() == []
    with pytest.raises(ValueError):
        r.commit("../x", change(rows, 1))


def test_bpe_counts(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    got = sorted(((r.doc_id, r.tokens) for r in token_counts.bpe_counts(odd, path, P.PATTERN).collect()), key=str)
    assert got == sorted(((d, len(bpe.encode_ordinary(t)) if t else 0) for d, t, *_ in ODD), key=str)


# ------------------------------------------------------------------------ classifiers


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(4, 0, 1), (5, 1, 0), (5, 1, 1), (6, None, None), (777, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    got = language.identify(odd, language.fitted(odd), ["doc_id"]).collect()
    by = {r.doc_id: r.found for r in got}
    assert len(got) == len(ODD) and all(by[d].lang == "und" and by[d].score == 0 and not by[d].accepted for d in (1, 2, 3, 7)) and by[8].lang != "und"
    assert all(0 <= r.found.score <= 1 for r in got)
    assert language.keep_identified(odd).columns == odd.columns and language.keep_identified(none).count() == 0
    assert {r.found.lang for r in language.identify(odd, language.train([], []), ["doc_id"]).collect()} == {"und"}


def test_hashed_features_of_texts_and_their_sums():
    import pyarrow as pa

    from trackmill.llm import common

    texts = ["Der Hund", "", "a", "ab", "x1y2 zz", "日本 words", "ten  words.and more", "ab"]
    buf, off = common.strings(pa.array(texts, pa.large_string()))
    h, edges = language.features(buf, off)
    table = np.random.default_rng(2).normal(size=(2 * language.BUCKETS, 3))
    sums, n = language._sums(table, buf, off)
    for i, t in enumerate(texts):
        alone, _ = language.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert (h[edges[i] : edges[i + 1]] == alone).all() and n[i] == len(alone) and np.allclose(sums[i], table[alone].sum(0))
        plain = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in t.lower().encode())
        assert n[i] == sum(plain[j + 1] != 32 for j in range(len(plain) - 2)) + sum(plain[j + 1] != 32 and plain[j + 2] != 32 for j in range(len(plain) - 3))


def test_more_languages_than_dimensions(spark):
    rng = random.Random(6)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for i in range(20)}
    docs = [(20 * i + j, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i in range(30) for j, k in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fitted(df)
    assert model["weights"] is not None
    got = language.identify(df, model, ["lang"]).collect()
    assert np.mean([r.lang == r.found.lang for r in got]) > 0.95


def test_an_odd_document_does_not_stop_rejection(spark):
    """One correct calibration document hardly above 1/L; a text in an unlearned language has about 1/L."""
    assert language._threshold(np.r_[0.3, np.full(200, 0.99)], 4) == 0.5 and language._threshold(np.full(50, 0.26), 4) > 1 / 4
    model = language.train([], []) | {"names": ["a", "b", "c", "d"], "table": np.zeros((2 * language.BUCKETS, 4), np.float32), "weights": None, "bias": np.zeros(4)}
    model["threshold"] = language._threshold(np.r_[0.3, np.full(200, 0.99)], 4)
    assert not language.identify(spark.createDataFrame([(1, "unheard of words")], DOCS), model, ["doc_id"]).first().found.accepted


def index_of(texts, labels, share):
    import pyarrow as pa

    from trackmill.llm import common

    of, x, _ = toxicity.terms(*common.strings(pa.array(texts, pa.large_string())))
    return toxicity.Index(*toxicity.bags(of, x), labels, list(range(len(texts))), share, k=6)


def test_nearest_examples_are_exact(monkeypatch):
    """As the operator runs, but for the sizes of blocks and of the dense part: several ways are to be taken by few texts."""
    rng = random.Random(5)
    texts = [" ".join(prose(rng, 30, 90) + (["bad", "worse"] if i % 3 == 0 else [])) for i in range(150)] + ["alone in its words", "alone in its words", ""]
    labels = [int(i % 3 == 0) for i in range(len(texts))]
    queries_ = [" ".join(prose(rng, 12, 90) + rng.choice([["bad"], [], ["worse", "bad", "bad"]])) for _ in range(60)] + ["alone in its words", "unheard", "", "w1"]

    def bag(t):
        w = Counter()
        for x in brute.plain(t):
            w.update([x] + [("prefix", x[:4])] * (len(x) > 4))
        return w

    bags, n0 = [bag(t) for t in texts], len(texts)
    df = Counter(x for b in bags for x in b)
    known = {x for b in bags for x in b}

    def vector(b):
        v = {x: (1 + np.log(n)) * (1 + np.log((1 + n0) / (1 + df[x]))) for x, n in b.items() if x in known}
        long = np.sqrt(sum(y * y for y in v.values()))
        return {x: y / long for x, y in v.items()}

    examples = [vector(b) for b in bags]
    for block, together, long in ((toxicity.BLOCK, toxicity.TOGETHER, toxicity.LONG), (256, 512, 10), (4, 7, 3), (1, 512, 10**6), (8, 32, 1)):
        for name, value in (("BLOCK", block), ("TOGETHER", together), ("LONG", long)):
            monkeypatch.setattr(toxicity, name, value)
        ix = index_of(texts, labels, {0: 0.5, 1: 1.0})
        import pyarrow as pa

        from trackmill.llm import common

        of, x, n = toxicity.terms(*common.strings(pa.array(queries_, pa.large_string())))
        got, place, score = ix.nearest(*ix.vectors(of, x, n))
        found = dict(zip(got.tolist(), zip(place.tolist(), score.tolist())))
        for i, q in enumerate(queries_):
            v = vector(bag(q))
            cosine = {j: c for j, e in enumerate(examples) if (c := sum(y * e.get(x, 0) for x, y in v.items())) > 0}
            want = sorted(cosine.values(), reverse=True)[:6]
            places, scores = found.get(i, ([], []))
            near = [(ix.ids[p], s) for p, s in zip(places, scores) if p >= 0]
            assert np.allclose([s for _, s in near], want) and all(abs(cosine[j] - s) < 1e-9 for j, s in near) and len({j for j, _ in near}) == len(near)


def test_toxicity(spark, small, odd, none, labels):
    found = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    rank, y = found.score.rank(), found.toxic == 1
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.94 and (found.predicted == found.toxic).mean() > 0.95  # without labels in the weights
    from pyspark.sql import functions as F

    big = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    opened, all_ = toxicity.examples(*big, ~toxicity.held_out()).looked
    assert 0 < opened < 0.45 * all_  # blocks that pruning leaves
    for marked in (labels, labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0")):
        index = toxicity.examples(odd, marked, F.lit(True))
        rows = toxicity.score(odd, index).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and toxicity.score(none, index).count() == 0
    named = toxicity.score(odd.withColumn("doc_id", F.col("doc_id").cast("string")), toxicity.examples(odd.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string")), F.lit(True)))
    assert named.count() == len(ODD)


def test_most_texts_have_neighbours_at_every_size(spark):
    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        docs = spark.read.parquet(f"{d}/documents.parquet")
        rows = toxicity.op10_toxicity(spark, d).join(docs.select("doc_id", "text"), "doc_id").where("trim(text) <> ''").collect()
        assert sum(not r.evidence for r in rows) < 0.05 * len(rows)


def test_quality(spark, odd, none, labels):
    found = quality.op6_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95
    from pyspark.sql import functions as F

    for marked in (labels, labels.where("false")):
        model = quality.fitted(odd, marked, F.lit(True))
        rows = quality.score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and quality.score(none, model).count() == 0


def test_views_exchange_their_surest_labels(monkeypatch):
    """Each round, what a view was surest of is added to what the other learns from, and to nothing else."""
    rng = np.random.default_rng(3)

    def rows(n):
        y = rng.integers(0, 2, n)
        return [(np.array([k, 2 + rng.integers(0, 30)], np.int32), np.ones(2, np.float32), np.zeros(quality.RATIOS, np.float32), np.array([k if rng.random() < 0.8 else 1 - k, 5 + rng.integers(0, 9), 20, 30], np.int32)) for k in y.tolist()], y.tolist()

    labelled, y = rows(60)
    pool, hidden = rows(200)
    monkeypatch.setattr(quality, "SURE", 10)
    seen, raw = {id_: [] for id_ in ("text", "meta")}, {"text": [], "meta": []}
    dense = quality._dense(pool)
    name = lambda x: "text" if x.shape[1] == quality.BUCKETS + quality.RATIOS else "meta"
    fit = quality._View.fit

    def spy(self, x, t):
        fit(self, x, t)
        seen[name(x)].append((x[40:], t[40:]))
        raw[name(x)].append(self.raw(dense[0 if name(x) == "text" else 1]))

    monkeypatch.setattr(quality._View, "fit", spy)
    model = quality.train(labelled, y, pool, {0: 1.0, 1: 1.0}, rounds=2)
    rate = float(np.mean(y))
    given = {"text": {}, "meta": {}}
    for r in range(2):
        for mine, other in (("text", "meta"), ("meta", "text")):
            z = raw[mine][r]
            up = [i for i in np.argsort(-z, kind="stable").tolist() if i not in given[other] and z[i] > 0][: round(10 * rate)]
            down = [i for i in np.argsort(z, kind="stable").tolist() if i not in given[other] and z[i] < 0][: round(10 * (1 - rate))]
            given[other].update({i: 1 for i in up} | {i: 0 for i in down})
        for k, m in (("text", 0), ("meta", 1)):
            x, t = seen[k][r + 1]
            assert len(x) == len(given[k]) > 0 and t.tolist() == [given[k][i] for i in sorted(given[k])] and (x == dense[m][sorted(given[k])]).all()
    assert len(seen["text"][0][0]) == 0 and np.mean([given["meta"][i] == hidden[i] for i in given["meta"]]) > 0.9 and np.isfinite(model["both"]).all()


def test_bpe_counts_roll_up(spark, small, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "text")
    counted = docs.join(token_counts.bpe_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "doc_id")
    r = token_counts.Rollup(spark, str(tmp_path))
    assert r.commit("all", token_counts.changes(counted, 1, version=F.lit("bpe-50k"), tokens=F.col("tokens")))
    want = Counter()
    for x in counted.select("source", "lang", "tokens").collect():
        want[x.source, x.lang] += x.tokens
    assert {(x.source, x.lang): x.tokens for x in r.totals().collect()} == dict(want)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
