import hashlib
import random

from ledgerloom.llm import chat_template
from ledgerloom.llm.queries import PROBE

ROWS = "conv_id long, turn long, role string, text string, turns string, start long"


def rows(spark):
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\/INST]", "<", "[", "s>", "hi", "\n", " ", "é😀", "/"]
    made = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<s>x", "", None]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randrange(12)))]), "clash", 1) for c in range(150) for t in range(rng.randrange(1, 9))]
    made += [(-1, 0, "user", PROBE, None, None), (-1, 1, "assistant", PROBE, None, None), (None, 2, "user", "n", None, None), (None, None, "assistant", "m", None, None)]
    made += [(900, 1, "assistant", "same", None, None)] * 3 + [(901, t, "assistant" if t % 7 else "user", f"t{t}", None, None) for t in range(600)] + [(902, 0, "assistant", "long " * 40_000, None, None)]
    rng.shuffle(made)
    return made, spark.createDataFrame(made, ROWS)


def test_reads_back_and_masks(spark):
    made, df = rows(spark)
    chats = chat_template.loss_text(chat_template.read_chats(chat_template.format_chats(df)))
    got = {r["conv_id"]: r for r in chats.collect()}
    by = {}
    for c, t, role, text, _, _ in made:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[2:] for x in turns] and r["n_turns"] == len(turns)
        assert r["loss_text"] == "".join(x[3] for x in turns if x[2] == "assistant")
        assert r["n_blocks"] == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count("<s>") == r["n_blocks"] == r["formatted"].count("</s>")
        for (s, n), x in zip(((x["start"], x["length"]) for x in r["loss_spans"]), [x for x in turns if x[2] == "assistant"], strict=True):
            assert r["formatted"][s : s + n].replace("\\", "") == x[3].replace("\\", "")


def test_no_python_and_one_shuffle(spark):
    _, df = rows(spark)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(chat_template.loss_text(chat_template.read_chats(chat_template.format_chats(df)))._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_empty_and_template_rules(spark):
    _, df = rows(spark)
    assert chat_template.format_chats(df.limit(0)).isEmpty()
    other = chat_template.ChatTemplate(open="<|start|>", body="<|role|>", join="<|more|>", close="<|end|>", loss_role="user")
    two = spark.createDataFrame([(1, 0, "user", "a<|end|>\\<\\|end|>"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    r = chat_template.loss_text(chat_template.read_chats(chat_template.format_chats(two, other), other), other).first()
    assert [x["text"] for x in r["turns"]] == ["a<|end|>\\<\\|end|>", "b"] and r["loss_text"] == "a<|end|>\\<\\|end|>b"
    try:
        chat_template.ChatTemplate(open="oops").markers()
        raise AssertionError("markers must begin with < or [")
    except ValueError:
        pass
    assert hashlib.sha256(b"").hexdigest()


def test_reading_null_and_foreign_output(spark):
    given = spark.createDataFrame([(1, None), (2, ""), (3, "no markers at all"), (4, "<s>user[INST]"), (5, "<s>user")], "conv_id long, formatted string")
    got = {r["conv_id"]: r["turns"] and [tuple(x) for x in r["turns"]] for r in chat_template.read_chats(given).collect()}
    assert got[1] is None and got[2] == [] and got[4] == [("user", "")] and got[5] == [("user", "")] and len(got[3]) == 1
