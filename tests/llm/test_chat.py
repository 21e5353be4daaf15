"""Windows against a plain reading of the turns."""

import hashlib
import random

from runlore.llm import chat


def conversations():
    pick = random.Random(9)
    words = ["hi", "a&b", "<|im_end|>", "&lt;|", "é🎈", "\n", "<|im_start|>assistant\n", "&amp;", "ok ok", "<", "|>", "&#10;"]
    rows = []
    for conv in range(40):
        for turn in range(pick.randrange(1, 30)):
            role = "system" if turn == 0 and conv % 3 else pick.choice(["user", "assistant", "assistant", "to\nol", "<|x"])
            rows.append((conv, turn, role, " ".join(pick.choice(words) for _ in range(pick.randrange(40)))))
    rows += [(100, 0, "user", None), (101, 0, None, "x"), (102, 5, "assistant", "b"), (102, 5, "assistant", "a"), (102, 5, "assistant", "a"), (102, None, "user", "last")]
    rows += [(103, 0, "system", "s"), (103, 1, "assistant", "long " * 3000), (103, 2, "user", "q"), (None, 0, "assistant", "no id"), (104, 0, "assistant", "")]
    return rows


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(own), digest(text), len(learned), digest(learned))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_read_back_matches_the_turns(spark):
    rows = conversations()
    for stride, history in ((512, 256), (20, 12), (3, 3), (5, 0)):
        got = chat.op7(chat.with_control_strings(table(spark, rows)), stride, history).collect()
        every = [*rows, *((-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(["user", "assistant"]))]
        assert {r.conv_id: tuple(r)[1:5] for r in got} == plain(every)
        assert len(got) == len({r[0] for r in every}) and all(r.formatted_chars > 0 for r in got)


def test_windows_keep_the_budget_the_system_turn_and_limited_history(spark):
    rows, stride, history = conversations(), 30, 20
    made = chat.windows(table(spark, rows), stride, history).withColumn("turns", chat.read_back(chat.F.col("formatted"))).collect()
    seen = {}
    for w in sorted(made, key=lambda w: (str(w.conv_id), w.window)):
        system = [t for t in w.turns if t.role == "system"]
        first = seen.setdefault(w.conv_id, system)
        assert system == first and (not system or w.turns[0] == system[0])
        tokens = [len(chat_tokens(t.text)) for t in w.turns]
        own, back = tokens[w["first"] :], tokens[len(system) if w.window else 0 : w["first"]]
        assert own and sum(back) <= history
        assert sum(own) < 2 * stride or len(own) == 1
    assert max(len(w.loss) for w in made) > 1


def chat_tokens(text):
    import re

    return re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", text.replace("é", "?").replace("🎈", "?"))


def test_empty_table_and_extra_columns(spark):
    rows = table(spark, conversations()).withColumn("window", chat.F.lit(1)).withColumn("i", chat.F.lit("x"))
    assert chat.op7(rows).count() == len({r[0] for r in conversations()})
    assert chat.op7(rows.limit(0)).count() == 0
