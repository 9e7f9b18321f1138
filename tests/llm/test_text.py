import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from trackmill.llm import common, jaccard, substrings

TEXT = st.text(alphabet=st.sampled_from("aB c\n\té日$1\x0b\x1f "), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 60))
def test_words_equal_the_patterns(texts, limit):
    for kind, fold, plain in ((common.SPACED, False, brute.spaced), (common.SPACED, True, lambda t: brute.spaced(t, True)), (common.WORDLIKE, True, brute.plain)):
        got = []
        for a, b, buf, off in common.chunks(pa.array(texts, pa.string()), limit):
            w = common.Words(buf, off, kind, fold)
            assert len(w.count) == b - a
            words = [w.buf[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
            got += [words[w.first[i] : w.first[i + 1]] for i in range(b - a)]
        assert got == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=6))
def test_equal_ranges_have_equal_fingerprints(rows):
    col = pa.array([" ".join(r) for r in rows])
    w = common.Words(*common.strings(col), common.SPACED, False)
    h, seen = w.hashes(), {}
    for i, x in enumerate(common.WORDS.windows(h, 3).tolist()):
        words = tuple(w.buf[s:e].tobytes() for s, e in zip(w.start[i : i + 3], w.end[i : i + 3]))
        assert seen.setdefault(words, x) == x
    assert len(set(seen.values())) == len(seen)
    low = substrings.minimisers(h, 5, 2)
    assert len(low) == max(0, len(h) - 4)
    grams = (common.WORDS.windows(h, 2) >> common.np.uint64(22)).tolist()
    assert [x >> 22 for x in low.tolist()] == [min(grams[i : i + 4]) for i in range(len(low))]


@given(st.lists(st.integers(-(2**40), 2**40), max_size=50))
def test_packed_columns_return(values):
    x = common.np.array(values, common.np.int64)
    a, b = common.unpack(common.pack(x, x.astype(common.np.int32)), "i8", "i4")
    assert (a == x).all() and (b == x.astype(common.np.int32)).all()


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=30))
def test_a_forest_connects_what_its_links_do(links):
    def groups(edges):
        up = {x: {x} for e in links for x in e}
        for a, b in edges:
            both = up[a] | up[b]
            for x in both:
                up[x] = both
        return {frozenset(g) for g in up.values()}

    assert groups(jaccard.forest(links)) == groups(links)
