import time

import pytest

from termini.llm import chat


def conversation(n):
    return [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(n)]


@pytest.mark.parametrize("n", range(2, 13))
def test_history_rewritten_at_any_turn_is_found(n):
    """A template that marks its first turn anew when the conversation has exactly `at` turns."""
    for at in range(2, n + 1):
        template = lambda ts, at=at: ("#" if len(ts) == at else "") + chat.turn_markup(ts)
        done = chat.formatted(conversation(n), template)
        # turn at - 1 changes what stands there, and the next one changes it back
        assert done.rewriting == [k for k in (at - 1, at) if k < n]
        first = done.rewriting[-1]
        assert all(t == chat.LOST for t in done.texts[:first])
        assert [done.output[a:b] for a, b in done.texts[first:]] == [f"text {k}" for k in range(first, n)]
    lasting = lambda ts: ("#" if len(ts) >= 2 else "") + chat.turn_markup(ts)
    assert chat.formatted(conversation(n), lasting).rewriting == [1]
    assert not chat.formatted(conversation(n)).rewrites


def test_rewriting_far_back_in_a_long_conversation_is_found():
    turns = conversation(300)
    hidden = lambda ts: chat.turn_markup(ts if len(ts) < 250 else [("user", "cut"), *ts[1:]])
    assert chat.formatted(turns, hidden).rewriting == [249]
    began = time.time()
    done = chat.formatted(conversation(2000))
    assert time.time() - began < 60 and not done.rewrites and chat.parsed(done.output) == conversation(2000)


def test_a_text_that_has_no_single_place():
    twice = lambda ts: "".join(f"{r}:{t}|{t};" for r, t in ts)
    silent = lambda ts: "".join(f"{r};" for r, _ in ts)
    for template in (twice, silent):
        assert chat.formatted(conversation(3), template).texts == [chat.LOST] * 3
    assert chat.formatted([]).output == "" and chat.formatted([]).spans == []


def test_rows_without_a_conversation_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, own string, output string"
    rows = [(None, 1, "user", "a", "x", "y"), (None, 1, "user", "a", "x", "y"), (None, 0, "assistant", "b", "x", "y"), (3, 0, None, None, "x", "y"), (3, None, "assistant", "z" * 300_000, "x", "y")]
    got = chat.op9(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in got) == [("-1", 2, 21), ("3", 2, 300_000), ("None", 1, 0), ("None", 1, 0), ("None", 1, 1)]
    assert [r.conv_id for r in chat.op9(spark.createDataFrame([], schema)).collect()] == [-1]
