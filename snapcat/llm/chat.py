"""Chat formatting in DataFrame functions only: a reversible template, budgeted windows and a loss mask.

Template: every turn is written `[INST]role[/INST]text</s>`. Control strings that occur inside a role or a text are
escaped by a backslash after their first character, backslashes themselves by doubling, so no text can end a turn or
open another, and unescaping gives back the very text.

Windows: prefix sums of turn tokens along a conversation choose turn-aligned spans. The sums first cut a conversation
into blocks of BLOCK capacities, so that a conversation of any length is worked on in bounded rows; within a block a
window takes turns as long as they fit into its capacity, that is the budget less the system turn and the history.
Every window but the first repeats the leading system turn and, before its own turns, as many of the turns just
before them as fit into `history` tokens and into what is left of the budget. Repeated turns are never targets: each
assistant text is under the loss mask of exactly one window. No turn is cut, so a window is above the budget only if it
has a single turn of its own that exceeds it, alone or with the system turn; such a window has no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the control strings of the template
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>")
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: capacities in a block of turns
BLOCK = 16


def escape(text: Column) -> Column:
    """Double backslashes, then put one after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undo escape()."""
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: words, numbers and signs, and four for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]")) + 4


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Format conversations given as rows (conv_id, turn, role, text) into windows.

    Returns conv_id, window (the number of its first own turn, from 0), n_tokens, n_system, n_history, formatted,
    loss_spans (array of start, length in code points of `formatted`). n_system and n_history count the repeated turns
    at the front of `formatted`.

    Null role or text counts as empty; rows that tie in turn go by role, then text; repeated rows are repeated turns;
    rows with a null conv_id form one conversation, a null turn comes first. Very long texts stay whole. Other columns
    are ignored. An empty table gives an empty one.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    )
    w = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", turn_tokens(F.col("_text")).cast("long").alias("_n"), F.row_number().over(w).alias("_i"))
    rows = rows.withColumn("_lead", (F.col("_i") == 1) & (F.col("_role") == "system"))
    rows = rows.select(
        "*",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_start"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
        F.first(F.when(F.col("_lead"), F.col("_n")).otherwise(F.lit(0).cast("long"))).over(upto).alias("_system"),
    )
    rows = rows.withColumn("_cap", F.greatest(F.lit(budget - history) - F.col("_system"), F.lit(1).cast("long")))
    wide = F.greatest(F.lit(BLOCK) * F.col("_cap"), F.lit(history + 1).cast("long"))
    block = lambda at: F.floor(at / wide).cast("long")
    # a turn goes to its block, to the next one if it may be history there, and the leading system turn to all
    rows = rows.withColumn("_own", block(F.col("_start")))
    to = F.when(F.col("_lead"), F.sequence(F.lit(0).cast("long"), block(F.col("_total") - 1))).otherwise(F.array_distinct(F.array("_own", block(F.col("_start") + history))))
    rows = rows.select("*", F.explode(to).alias("_block"))
    turn = F.struct(
        F.col("_i").alias("i"), (F.col("_own") == F.col("_block")).alias("own"), F.col("_n").alias("n"), F.col("_start").alias("start"),
        F.col("_role").alias("role"), F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(CLOSE)).alias("head"), escape(F.col("_text")).alias("body"),
    )
    blocks = rows.groupBy("conv_id", "_block").agg(F.first("_cap").alias("_cap"), F.first("_system").alias("_system"), F.array_sort(F.collect_list(turn)).alias("_turns"))
    blocks = blocks.withColumn("_mine", F.filter("_turns", lambda t: t["own"])).filter(F.size("_mine") > 0)
    # places of the turns that begin windows: the sum so far, and the places found
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, t: Column) -> Column:
        new = (s["at"] == 0) | (s["used"] + t["n"] > F.col("_cap"))
        return F.struct(
            F.when(new, t["n"]).otherwise(s["used"] + t["n"]).alias("used"), (s["at"] + 1).alias("at"), F.when(new, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts")
        )

    blocks = blocks.withColumn("_cuts", F.aggregate("_mine", state, step, lambda s: s["cuts"]))
    ends = F.concat(F.slice("_cuts", F.lit(2), F.size("_cuts")), F.array(F.size("_mine")))
    spans = blocks.select("*", F.explode(F.arrays_zip(F.col("_cuts").alias("lo"), ends.alias("hi"))).alias("_span"))
    spans = spans.withColumn("_win", F.slice("_mine", F.col("_span.lo") + 1, F.col("_span.hi") - F.col("_span.lo")))
    spans = spans.withColumn("_first", F.col("_win")[0]).withColumn("_size", F.aggregate("_win", F.lit(0).cast("long"), lambda s, t: s + t["n"]))
    is_lead = lambda t: (t["i"] == 1) & (t["role"] == "system")
    again = F.when(F.col("_first.i") > 1, F.filter("_turns", is_lead)).otherwise(F.slice("_turns", 1, 0))
    room = F.least(F.lit(history).cast("long"), F.lit(budget) - F.col("_system") - F.col("_size"))
    before = F.filter("_turns", lambda t: (t["i"] < F.col("_first.i")) & (F.col("_first.start") - t["start"] <= room) & ~is_lead(t))
    spans = spans.select("conv_id", "_first", "_win", again.alias("_again"), before.alias("_history"))
    spans = spans.withColumn("_all", F.concat("_again", "_history", "_win"))
    skip = F.size("_again") + F.size("_history")
    width = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    masked = F.transform(
        "_all",
        lambda t, k: F.struct(
            (F.aggregate(F.slice("_all", F.lit(1), k), F.lit(0), lambda s, x: s + width(x)) + F.length(t["head"])).alias("start"),
            F.length(t["body"]).alias("length"),
            ((k >= skip) & (t["role"] == "assistant")).alias("target"),
        ),
    )
    return spans.select(
        "conv_id",
        (F.col("_first.i") - 1).cast("long").alias("window"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda s, t: s + t["n"]).alias("n_tokens"),
        F.size("_again").alias("n_system"),
        F.size("_history").alias("n_history"),
        F.array_join(F.transform("_all", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(masked, lambda m: m["target"]), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))).alias("loss_spans"),
    )


def parse_window(formatted: Column) -> Column:
    """Turns of a formatted window: array of (role, text), unescaped."""
    turns = F.slice(F.split(formatted, r"</s>", -1), F.lit(1), F.size(F.split(formatted, r"</s>", -1)) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, CLOSE, 1)) + len(CLOSE) + 1)).alias("text"),
        ),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns (array of role, text) and loss (the text under the mask), from format_chats()."""
    own = F.slice(F.col("_parsed"), F.col("n_system") + F.col("n_history") + 1, F.size("_parsed"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = windows.withColumn("_parsed", parse_window(F.col("formatted"))).select(
        "conv_id", F.length("formatted").cast("long").alias("_chars"), F.struct("window", own.alias("own"), F.array_join(loss, "").alias("loss")).alias("_w")
    )
    rows = rows.groupBy("conv_id").agg(F.sum("_chars").alias("formatted_chars"), F.array_sort(F.collect_list("_w")).alias("_ws"))
    return rows.select(
        "conv_id",
        "formatted_chars",
        F.flatten(F.transform("_ws", lambda w: w["own"])).alias("turns"),
        F.array_join(F.transform("_ws", lambda w: w["loss"]), "").alias("loss"),
    )
