import brute
import pytest
from pyspark.sql import functions as F

from skylattice.llm import chat
from skylattice.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def compared(rows):
    windows = chat.format_conversations(rows)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    assert got == brute.chats([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
    return windows


def test_conversations_come_back(spark):
    compared(table(spark, "/root/testdata/sf0.01", "conversations"))


ODD = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "system", "a \\ <\\|im_end|> b"), (2, 1, "assistant", None), (2, 2, None, "<|im_start|>x<|im_sep|>y<|im_end|>\\"),
    (2, 3, "assistant", "\\\\ \\<s>[INST]\\[/INST]<<s><<SYS>>"), (2, None, "assistant", "early"), (None, None, "assistant", "no id"), (None, 1, "assistant", "no id, late"), (3, 5, "a<|im_sep|>b", "odd role"),
    (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"), (5, -9, "user", "Ünï 😀 — 日本"), (5, -8, "assistant", "😀😀 <s>"), (6, 0, "user", ""), (7, 1 << 40, "assistant", "far"), (7, -(1 << 40), "system", "first"),
]


def test_odd_turns(spark):
    rows = spark.createDataFrame(ODD, SCHEMA).withColumns({"c": F.lit("x"), "window": F.lit(1), "before": F.lit(2), "item": F.lit(3)})
    text = "".join(r.text for r in compared(rows).collect())
    for c in chat.CONTROL[3:]:
        assert c not in text
    assert text.count(chat.START) == text.count(chat.SEP) == text.count(chat.END)
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("system", [True, False])
def test_windows_stay_within_the_budget(spark, system):
    rows = [(1, k, "system" if system and not k else "user" if k % 2 else "assistant", " ".join(f"w{k}" for _ in range(k * 37 % 300))) for k in range(700)]
    rows += [(2, 0, "assistant", "long " * 3000), (2, 1, "assistant", "short"), (2, 2, "user", "ask"), (2, 3, "assistant", "answer")]
    windows = compared(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_tokens <= chat.BUDGET or (r.conv_id == 2 and r.window == 0) for r in windows)
    for r in windows:  # repeats are the system turn and at most HISTORY tokens, and are not under the mask
        parts = r.text.split(chat.START)[1:]
        again = parts[1 if system and r.conv_id == 1 and r.window else 0 : r.repeated]
        assert sum(len(p.split(chat.SEP)[1].split()) for p in again) <= chat.HISTORY
        if system and r.conv_id == 1:
            assert parts[0].startswith("system")
        assert len(r.loss) == sum(p.startswith("assistant") for p in parts[r.repeated :])
        assert all(r.text[s.first - len(chat.SEP) : s.first] == chat.SEP and r.text[s.end :].startswith(chat.END) for s in r.loss)
    assert max(r.repeated for r in windows) > 1


def test_only_dataframe_operations(spark):
    plan = chat.digests(chat.format_conversations(table(spark, "/root/testdata/sf0.001", "conversations")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
