import hashlib
import re

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapcat.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "a\\</s>", "\\\\[INST]", "[\\INST]", "<s></s>", "", "\\", "[/INST]\n", "é日本 <|x|>"]


def make(rng, convs=12):
    rows = []
    for c in range(convs):
        if c % 2:
            rows.append((c, 0, "system", "be brief " * 5))
        for t in range(1, int(rng.integers(2, 40))):
            text = rng.choice(NASTY) if rng.random() < 0.3 else "word " * int(rng.integers(0, 120))
            rows.append((c, t, "user" if t % 2 else "assistant", str(text)))
    return rows


def check(rows, out):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for v in by.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    got = {r.conv_id: r for r in out}
    assert set(got) == set(by)
    for c, turns in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].loss == "".join(x for _, r, x in turns if r == "assistant")


def test_round_trip(spark):
    rows = make(np.random.default_rng(0))
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=256, history=64).cache()
    check(rows, chat.read_back(windows).collect())
    assert windows.count() > 12
    for r in windows.collect():
        n_turns = r.formatted.count("</s>")
        # above the budget: one own turn, no history
        assert r.n_tokens <= 256 or n_turns - r.n_system == 1
        if r.window and r.conv_id % 2:
            assert r.n_system == 1 and r.formatted.startswith("[INST]system[/INST]")
        for s in r.loss_spans:
            assert r.formatted[: s.start].endswith("[INST]assistant[/INST]") and r.formatted[s.start + s.length :].startswith("</s>")


def plain_windows(rows, budget, history):
    """Per conversation, windows as (first turn, turns with the system turn and history, own turns), one turn after the other."""
    tokens = lambda x: len(regex.findall(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]", x)) + 4
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role, text))
    out = {}
    for c, turns in by.items():
        turns.sort()
        n = [tokens(x[2]) for x in turns]
        lead = turns[0][1] == "system"
        system = n[0] if lead else 0
        cap = max(1, budget - history - system)
        wide = max(chat.BLOCK * cap, history + 1)
        cuts, used, start = [], 0, 0
        for i, k in enumerate(n):
            if not cuts or used + k > cap or start // wide != (start - n[i - 1]) // wide:
                cuts.append(i)
                used = 0
            used, start = used + k, start + k
        for lo, hi in zip(cuts, [*cuts[1:], len(n)], strict=True):
            room, h = min(history, budget - system - sum(n[lo:hi])), lo
            while h > 0 and not (lead and h == 1) and sum(n[h - 1 : lo]) <= room:
                h -= 1
            out.setdefault(c, []).append((lo, (system if lo else 0) + sum(n[h:hi]), int(lead and lo > 0), lo - h))
    return out


def test_windows_match_a_plain_version_and_keep_the_budget(spark):
    rng = np.random.default_rng(4)
    rows = [(c, t, "system" if t == 0 and c % 3 else ["user", "assistant"][t % 2], "w " * int(rng.choice([0, 3, 40, 90, 150, 300]))) for c in range(12) for t in range(int(rng.integers(1, 90)))]
    rows += [(99, t, "system" if t == 0 else "user", "w " * n) for t, n in enumerate((180, 200, 50, 5, 230, 2, 2))]
    rows += [(100, t, "user", "w " * 56) for t in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in chat.format_chats(df, budget=256, history=64).select("conv_id", "window", "n_tokens", "n_system", "n_history", F.size(chat.parse_window(F.col("formatted"))).alias("k")).collect():
        got.setdefault(r.conv_id, []).append((r.window, r.n_tokens, r.n_system, r.n_history))
        assert r.n_tokens <= 256 or r.k - r.n_system == 1
    assert {c: sorted(v) for c, v in got.items()} == plain_windows(rows, 256, 64)


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "assistant", "y"), (2, None, "assistant", "n"), (2, 0, "user", ""), (3, 1, "assistant", "w " * 30_000), (3, 2, "assistant", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("clash")).withColumn("_text", F.lit(0))
    check(rows, chat.read_back(chat.format_chats(df)).collect())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def python_escape(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def python_unescape(text):
    for c in chat.CONTROLS:
        text = text.replace(c[0] + "\\" + c[1:], c)
    return text.replace("\\\\", "\\")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*NASTY, "[", "INST]", "/", "<", "s>", "\\", "x"]), max_size=10).map("".join))
def test_escape_is_reversible(text):
    coded = python_escape(text)
    assert python_unescape(coded) == text
    assert not any(c in coded for c in chat.CONTROLS)


def test_column_escape_is_the_same(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.e == python_escape(r.t) and r.u == r.t


def test_query_is_native(spark, tmp_path):
    spark.createDataFrame(make(np.random.default_rng(1)), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    df = queries.op2_chat_format(spark, str(tmp_path))
    assert not re.search("EvalPython|InPandas|InArrow|ExistingRDD", df._jdf.queryExecution().executedPlan().toString())
    row = df.filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
