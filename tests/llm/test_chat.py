import hashlib

from hypothesis import given, strategies as st
from polyagg.llm.chat import Formatter, Template, format_conversations, read_back

PIECES = [*Template().controls(), "<", "[", "/", "s>", "INST]", "1;", ";", "é", " ", "a"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]), st.lists(st.sampled_from(PIECES)).map("".join)), max_size=6))
def test_round_trip(turns):
    f = Formatter()
    assert [*f.parse("".join(p for r, t in turns for p, _ in f.segments(r, t)))] == turns


def digests(turns):
    said = [t or "" for r, t in turns if r == "assistant"]
    return (
        len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(),
        sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(),
    )


def test_digests(spark):
    convs = {
        -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
        1: [("system", "s"), ("user", None), ("assistant", "\\1;<s>é")],
        2: [("assistant", "first")],
        3: [("user", "a"), ("user", "a"), ("tool", "x" * 100_000), (None, "")],
        None: [("user", ""), ("assistant", "")],
    }
    rows = [(c, i, r, t, "extra") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert set(out) == set(convs)
    for c, turns in convs.items():
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == digests(turns)
    assert {c: out[c].valid for c in convs} == {-7: True, 1: True, 2: False, 3: False, None: True}
    assert out[2].problem == "assistant after start" and out[3].problem == "user after user"


def test_empty_and_ties(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert read_back(format_conversations(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, None, "user", "z"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "b")]
    turns = [("user", "z"), ("assistant", "a"), ("user", "b"), ("user", "b")]
    (r,) = read_back(format_conversations(spark.createDataFrame(rows, schema))).collect()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(turns)
