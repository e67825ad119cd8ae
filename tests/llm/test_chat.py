import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribelake.llm import chat
from scribelake.llm.queries import CONTROL_TEXT, QUERIES, conversations_with_control

SCHEMA = "conv_id long, turn long, role string, text string, window string, pieces int"


def ordered(rows):
    found = {}
    for r in rows:
        found.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    low = float("-inf")
    return {k: sorted(v, key=lambda t: (low if t[0] is None else t[0], *t[1:])) for k, v in found.items()}


def check(turns, **options):
    windows = chat.read_windows(chat.format_windows(turns, **options)).collect()
    want = ordered(turns.collect())
    by_conv = {}
    for w in sorted(windows, key=lambda w: w.window):
        by_conv.setdefault(w.conv_id, []).append(w)
    assert set(by_conv) == set(want)
    for conv, own in by_conv.items():
        assert [w.window for w in own] == list(range(len(own)))
        new = [(t.role, t.text) for w in own for t in w.new_turns]
        assert new == [t[1:] for t in want[conv]]
        learned = [x for w in own for x in w.loss_texts]
        assert learned == [text for role, text in new if role == "assistant"]
        for w in own:
            assert w.text.count(chat.END) == w.turns
            assert re.sub(r"</turn>\n|### ", "", w.text).count("</turn>") == 0
    return by_conv


def test_all_conversations(spark, sf_dir):
    turns = conversations_with_control(spark, sf_dir)
    check(turns)
    windows = check(turns, budget=60, history_tokens=20)
    system = {k for k, v in ordered(turns.collect()).items() if v[0][1] == "system"}
    later = [w for own in windows.values() for w in own[1:]]
    assert later and any(w.repeated == 2 for w in later)
    for w in later:
        assert w.text.startswith("### system: ") == (w.conv_id in system)


@pytest.mark.parametrize("budget", [2, 40, 200])
def test_windows_keep_to_the_budget(spark, budget):
    rows = [(1, 0, "system", "s " * 5, "", 0)]
    rows += [(1, k, "user" if k % 2 else "assistant", "w " * (k * 7 % 11), "", 0) for k in range(1, 60)]
    for w in check(spark.createDataFrame(rows, SCHEMA), budget=budget, history_tokens=budget // 4)[1]:
        new = w.turns - w.repeated
        assert w.tokens <= budget or new == 1 or budget < 40


def test_a_system_turn_above_the_budget_is_repeated_whole(spark):
    rows = [(1, 0, "system", "s " * 300, "", 0)]
    rows += [(1, k, "user" if k % 2 else "assistant", "w w w", "", 0) for k in range(1, 9)]
    windows = check(spark.createDataFrame(rows, SCHEMA), budget=100)[1]
    assert len(windows) == 8
    for w in windows:
        assert w.text.startswith("### system: s s ") and w.turns - w.repeated == (2 if w.window == 0 else 1)
        assert w.tokens <= 300 + chat.HISTORY_TOKENS + 3


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no id", "", 0),
        (1, None, "user", None, "", 0),
        (1, 1, None, "### x: </turn>\n", "", 0),
        (1, 1, "assistant", "", "", 0),
        (1, 1, "assistant", "", "", 0),
        (2, 5, "a: b\\", "text: more\\", "", 0),
        (2, 6, "assistant", "w " * 30_000, "", 0),
        (3, 0, "system", "only", "", 0),
        (4, 2, "user", "x", "", 0),
        (4, 3, "system", "late", "", 0),
    ]
    check(spark.createDataFrame(rows, SCHEMA))
    check(spark.createDataFrame(rows, SCHEMA), budget=10, history_turns=0, history_tokens=0)
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\#</turn>: \nA", max_size=20), min_size=1, max_size=40))
def test_escapes_are_reversible(spark, texts):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped = frame.select("t", chat.escape(F.col("t")).alias("e"))
    for r in escaped.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r.back == r.t and "</turn>" not in r.e and "###" not in r.e


def test_query_by_hand(spark, sf_dir):
    rows = {r.conv_id: r for r in QUERIES["op4_chat_windows"](spark, sf_dir).collect()}
    for conv, turns in ordered(conversations_with_control(spark, sf_dir).collect()).items():
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        r = rows.pop(conv)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        if conv == -7:
            assert learned == CONTROL_TEXT
    assert not rows


def test_no_python(spark, sf_dir):
    plan = QUERIES["op4_chat_windows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
