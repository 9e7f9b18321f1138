"""Every operator on texts beyond the stretch that is tokenized together, beside short ones, with extra columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import CLASHING, prose
from trackmill.llm import common, decontaminate, jaccard, language, licenses, mixing, quality, substrings, token_counts, toxicity

rng = random.Random(12)
WORDS = prose(rng, 220_000, 10**6)
LONG = " ".join(WORDS)
ROWS = [(1, LONG, "a", "en"), (2, "a short text of ten words, or a few more or less", "a", "en"), (3, LONG + " and its end", "b", "de"), (4, None, None, None), (5, " ".join(WORDS[100_000:100_060]), "b", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > common.CHUNK
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit(1) for c in CLASHING}).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_windows_and_passages(spark, docs):
    pairs = [r[:2] for r in ROWS]
    items = [(7, " ".join(WORDS[199_990:200_010])), (8, "and its end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.SET_BYTES, 10):
        got = decontaminate.scan(docs, bench, columns=["doc_id"], set_bytes=size)
        assert sorted(((r.doc_id, r.hit.n_words, len(r.hit["words"]), list(r.hit["items"])) for r in got.collect()), key=str) == brute.hits(pairs, items)
    assert sorted(map(tuple, substrings.digest(docs).collect()), key=str) == brute.digest(pairs)


def test_near_copies(docs):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == brute.components([r[:2] for r in ROWS])


def test_words_sizes_and_totals(spark, docs, tmp_path):
    assert {d: r.n_words for d, r in by_id(licenses.scan(docs)).items()} == {d: len(brute.plain(t)) for d, t, *_ in ROWS}
    plan = by_id(mixing.plan(docs))
    assert {d: r["size"] for d, r in plan.items()} == {d: len(brute.spaced(t)) for d, t, *_ in ROWS}
    r = token_counts.Rollup(spark, str(tmp_path))
    r.commit("all", token_counts.changes(docs, 1, version=F.lit("v"), tokens=token_counts._words(r"[\x20\x09-\x0D]+")))
    want = {}
    for _, t, s, lang in ROWS:
        want[s, lang] = want.get((s, lang), 0) + len(brute.spaced(t))
    assert {(x.source, x.lang): x.tokens for x in r.totals().collect()} == want


def test_models_learn_from_and_score_long_texts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int").withColumns({c: F.lit(2) for c in CLASHING})
    index = toxicity.examples(docs, labels, F.lit(True))
    assert sorted(index.ids) == [1, 2, 3, 5]
    scores = by_id(toxicity.score(docs, index))
    assert len(scores) == len(ROWS) and scores[3].evidence[0].doc_id in (1, 3) and scores[3].score > scores[2].score
    assert len(by_id(quality.score(docs, quality.fitted(docs, labels, F.lit(True))))) == len(ROWS)
    found = by_id(language.identify(docs, language.fitted(docs), ["doc_id"]))
    assert found[4].found.lang == "und" and all(0 <= r.found.score <= 1 for r in found.values())


def test_a_digest_of_a_long_text(docs):
    kept = by_id(substrings.digest(docs))[1]
    assert kept.n_removed == 0 and kept.kept_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
