"""Chat formatting into budgeted, turn-aligned windows with a loss mask.
Built-in Spark expressions only.

A conversation's turns, by (turn, role, text), get prefix sums of their token
estimates. The sums choose the windows: a window takes new turns while its new
turns, the repeated system turn and the repeated history fit the budget (a turn
that alone exceeds it has a window of its own; texts are never cut). A window
after the first repeats the system turn, if the first turn is one, and up to
``history`` turns before it of ``history_budget`` tokens at most. Repeated turns
carry no loss, so every assistant text is under the mask exactly once.

Template: ``<s>`` then for each turn ``[INST] role [/INST] text</s>``. Control
strings inside roles and texts get a backslash after their first character, one
more if they have some already; taking one away restores the text.

Defined cases: null role or text is empty; null turn sorts first; a null conv_id
is a conversation of its own; repeated rows are turns of their own; an empty
table gives no rows; further input columns are not read. A conversation is
one value by contract (its digest runs over all of it), so its turns meet in one
row; before that nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings, fixed values.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
_TAIL = r"(/?s>|/?INST\])"
_OPEN, _MIDDLE, _CLOSE, _START = "[INST] ", " [/INST] ", "</s>", "<s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, and the template's own tokens."""
    return (F.ceil(F.octet_length(text) / 4) + 6).cast("long")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(_OPEN), turn["role"], F.lit(_MIDDLE))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 2,
                   history_budget: int = 256) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, loss_spans (code points of
    ``text`` from 0, end exclusive), n_repeated (turns without loss at its start), tokens."""
    turns = conversations.select(
        "conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"),
        F.coalesce("text", F.lit("")).alias("raw")).withColumn("body", escape(F.col("raw"))) \
        .withColumn("tokens", token_estimate(F.col("body")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("upto", F.sum("tokens").over(order))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("upto", "role", "body", "tokens"))).alias("turns"))

    all_turns = F.col("turns")
    system = F.when(all_turns[0]["role"] == "system", 1).otherwise(0)
    grouped = grouped.withColumn("system", system)

    def repeated(i: Column) -> Column:
        """How many turns before turn i the window that begins there repeats."""
        before = F.get(all_turns, i)["upto"] - F.get(all_turns, i)["tokens"]
        return F.size(F.filter(
            F.array(*[F.lit(k) for k in range(1, history + 1)]),
            lambda k: (i - k >= F.col("system"))
            & (before - F.get(all_turns, i - k)["upto"] + F.get(all_turns, i - k)["tokens"] <= history_budget)))

    def reserve(i: Column) -> Column:
        kept = F.when((i > 0) & (F.col("system") == 1), all_turns[0]["tokens"]).otherwise(0)
        before = F.get(all_turns, i)["upto"] - F.get(all_turns, i)["tokens"]
        n = repeated(i)
        return kept + F.when(n > 0, before - F.get(all_turns, i - n)["upto"] + F.get(all_turns, i - n)["tokens"]).otherwise(0)

    def step(state: Column, turn: Column) -> Column:
        i = state["i"]
        new = (i == 0) | (turn["upto"] - state["base"] > budget - state["reserve"])
        return F.struct(
            (i + 1).alias("i"),
            F.when(new, turn["upto"] - turn["tokens"]).otherwise(state["base"]).alias("base"),
            F.when(new, reserve(i)).otherwise(state["reserve"]).cast("long").alias("reserve"),
            F.when(new, F.concat(state["starts"], F.array(i))).otherwise(state["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("reserve"),
                    F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("turns", zero, step, lambda state: state["starts"])
    grouped = grouped.withColumn("starts", starts)
    windows = grouped.select("conv_id", "turns", "system", "starts", F.posexplode("starts").alias("window", "first"))
    windows = windows.withColumn("past", F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns"))) \
        .withColumn("n_history", repeated(F.col("first"))) \
        .withColumn("n_system", F.when(F.col("window") > 0, F.col("system")).otherwise(0))
    windows = windows.select(
        "conv_id", "window", (F.col("n_history") + F.col("n_system")).alias("n_repeated"),
        F.concat(F.slice("turns", F.lit(1), F.col("n_system")),
                 F.slice("turns", F.col("first") - F.col("n_history") + 1,
                         F.col("past") - F.col("first") + F.col("n_history"))).alias("parts"))

    def place(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(_head(turn))
        end = begin + F.length(turn["body"])
        bears = (state["i"] >= F.col("n_repeated")) & (turn["role"] == "assistant")
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((state["i"] + 1).alias("i"), (end + len(_CLOSE)).alias("at"),
                        F.when(bears, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("i"), F.lit(len(_START)).alias("at"),
                    F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return windows.select(
        "conv_id", "window",
        F.concat(F.lit(_START), F.array_join(F.transform("parts", lambda t: F.concat(
            _head(t), t["body"], F.lit(_CLOSE))), "")).alias("text"),
        F.aggregate("parts", none, place, lambda state: state["spans"]).alias("loss_spans"),
        "n_repeated",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("tokens"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted window: array of (role, text), unescaped."""
    turns = F.split(F.substring(text, len(_START) + 1, F.length(text)), _CLOSE, -1)
    head = r"(?s)^\[INST\] (.*?) \[/INST\] "
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(
        unescape(F.regexp_extract(t, head, 1)).alias("role"),
        unescape(F.regexp_replace(t, head, "")).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say when read back: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_windows."""
    own = F.slice(F.col("read"), F.col("n_repeated") + 1, F.size("read"))
    read = windows.withColumn("read", read_turns(F.col("text"))).select(
        "conv_id", "window", F.size(own).alias("n"),
        F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        read_loss(F.col("text"), F.col("loss_spans")).alias("loss"), F.length("text").alias("chars"))
    whole = lambda name: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("window", name))), lambda w: w[name]), "")
    return read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), whole("said").alias("said"), whole("loss").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"),
    ).select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
             F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
             "formatted_chars", "n_windows")
