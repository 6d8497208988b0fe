import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from matchweave.llm import chat_format as C

PIECES = st.sampled_from([*C.RESERVED, "\\", "<", "[", "/", "s>", "INST]", "a", "é", "\n", " "])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = C.escape(text)
    assert C.unescape(hidden) == text
    assert not any(r in hidden for r in C.RESERVED)


def test_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be <<SYS>> nice", 9), (1, 1, "user", "é😀\n\x00 hi", 9), (1, 2, "assistant", said, 9), (1, 3, "assistant", None, 9), (2, 0, "tool", "x", 9), (2, 1, None, "y", 9), (None, 0, "user", "z", 9), (1, 3, "user", "tie", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    turns = C.format_turns(df)
    assert turns.count() == len(rows)
    out = {r.conv_id: r for r in C.digests(turns).collect()}
    want = "".join(f"{a}\n{b}\n" for a, b in [("system", "be <<SYS>> nice"), ("user", "é😀\n\x00 hi"), ("assistant", said), ("assistant", ""), ("user", "tie")])
    assert out[1].n_turns == 5 and out[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert out[1].loss_chars == len(said) and out[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[2].loss_chars == 0 and out[None].n_turns == 1
    assert C.digests(C.format_turns(df.limit(0))).count() == 0


def test_mask_covers_answers_only():
    ids, mask, bounds, strings = C.assemble([C._pieces("user", "question"), C._pieces("assistant", "answer")])
    assert not mask[: bounds[1]].any() and mask[bounds[1] :].all() and len(ids) == bounds[-1]
    assert strings == ["[INST]question[/INST]", "answer</s>"]
