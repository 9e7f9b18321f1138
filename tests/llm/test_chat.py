import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests import duck
from trackmill.llm import chat

PIECES = [*chat.CONTROL, chat.START, chat.SEP, chat.END, "<|image|>", "\\", "<", "|", ">", "[", "/", "s>", "INST]", "<\\|", "\n", "é", "日本", "a", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.one_of(st.lists(st.sampled_from(PIECES), min_size=1, max_size=6).map("".join).filter(bool), st.sampled_from(["image", "audio", "document"]).map(lambda k: (k,))), max_size=5)), max_size=4))
def test_turns_are_read_back(turns):
    blank = dict.fromkeys(["ref", "width", "height", "seconds", "pages", "text"])
    marked, want = "", []
    for role, parts in turns:
        f = chat.turn(role, [blank | ({"kind": "text", "text": p} if isinstance(p, str) else {"kind": p[0]}) for p in parts], chat.Costs(), ("assistant",))
        marked += "".join(f.out)
        joined = []  # neighbouring texts are one
        for kind, text in [("text", p) if isinstance(p, str) else (p[0], "") for p in parts]:
            if joined and kind == "text" == joined[-1][0]:
                joined[-1] = ("text", joined[-1][1] + text)
            else:
                joined.append((kind, text))
        want.append((role, joined))
    assert chat.read_back(marked) == want


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, **x: dict.fromkeys(["text", "ref", "width", "height", "seconds", "pages"]) | {"kind": kind} | x
    parts = [part("text", text="see <s> here"), part("image", ref="a.png", width=100, height=28), None, part("audio", ref="b.wav", seconds=1.5), part(None, text="and"), part("document", ref="c.pdf", pages=3), part("film", ref="d"), part("image", ref=None, width=-5)]
    df = spark.createDataFrame([(1, 0, "assistant", parts, 9), (1, 1, None, None, 9)], f"conv_id long, turn int, role string, parts array<{chat.PART}>, mask int")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert a.marked == "<|im_start|>assistant<|im_sep|>see <\\s> here<|image|><|audio|>and<|document|><|attachment|><|image|><|im_end|>"
    assert [(x.kind, x.ref, x.tokens) for x in a.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("attachment", "d", 0), ("image", None, 1)]
    assert all(a.marked[x.place :].startswith(f"<|{x.kind}|>") for x in a.attachments)
    assert a.tokens == 3 + 4 + 38 + 1 + 1536 + 1
    assert [a.marked[s.start : s.end] for s in a.mask] == ["see <\\s> here", "and"]
    assert b.marked == chat.START + chat.SEP + chat.END and b.mask == [] and b.attachments == []
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}[1]
    assert got.n_turns == 2 and got.loss_chars == len("see <s> hereand")


def test_odd_conversations_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice([None, "", "x " * 20000, *("".join(rng.choices(PIECES, k=9)) for _ in range(6))])) for c in (None, 1, 2, 3) for t in range(12 if c != 3 else 3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS marked", "2 AS n_turns", "3 AS tokens")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert set(got) == {None, 1, 2, 3}
    for c, r in got.items():
        own = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        learned = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.START + chat.SEP + chat.END) + len(chat.escape(role)) + len(chat.escape(text)) for _, role, text in own)
    assert chat.digests(chat.format_turns(df.where("false"))).collect() == []


def test_query_equals_sql(spark, small):
    duck.assert_same(chat.op13_chat_format(spark, small), duck.connect(small), chat.ORACLE_SQL)
