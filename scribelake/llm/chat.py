"""Chat formatting in budgeted windows.

*Template.*  A turn reads ``### role: text</turn>`` and a line feed.  Inside roles and
texts a backslash goes before every backslash, before the slash of ``</turn>`` and before
each number sign that has another on both sides; in roles before colons too.  So no text
holds a control string, formatted text is cut by plain search, and taking one backslash
away wherever one stands restores what was there.

*Windows.*  The running sum of a conversation's tokens cuts it at multiples of half the
room a window has for new turns, always between turns: a turn belongs to the half in which
it begins, and one longer than half ends its window.  So a window holds no more new tokens
than its room, or a few turns and one long one, which is never cut.  The room is what the
budget leaves after the system turn and the history, and one token at least: a system turn
that alone exceeds the budget is still repeated whole, so each window then holds it, the
history, and one new turn or a few of no tokens.  Every window repeats the system turn
(a first turn whose role is system) and then up to ``history_turns`` earlier turns, as far
as ``history_tokens`` reach back from its start.  The loss mask covers the texts of
assistant turns where they are new; repeated ones are masked out.

All steps are built-in expressions: window functions for the sums, then one group per
window, which the budget bounds, except for a single long turn.

Defined results: turns are ordered by number, NULL first, then role and text; NULL roles
and texts are empty; NULL is a conversation of its own; empty texts are turns of no
tokens; rows that repeat a turn are turns like others.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
END = "</turn>\n"
# tokens as words and punctuation marks
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_CONTROL = r"\\|(?<=<)/(?=turn>)|(?<=#)#(?=#)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"\\$0"))


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, F.lit(_CONTROL + "|:"), F.lit(r"\\$0"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), escape_role(role), F.lit(": "))


def _piece(kind: Column) -> Column:
    """A turn as it stands in a window; kind is 0 for the system turn, 1 repeated, 2 new."""
    return F.struct(
        F.col("place"),
        kind.alias("kind"),
        _head(F.col("role")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("learned"),
        F.col("tokens"),
    )


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(_TOKEN)).cast("long"))


def format_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per window: conv_id, window, text, loss, repeated, turns, tokens.

    ``loss`` is an array of structs (start, end) of code points of ``text``; the first
    ``repeated`` of the window's ``turns`` are the system turn, except in the first
    window, and the history.
    """
    if budget < 2 or history_turns < 0 or history_tokens < 0:
        raise ValueError("the budget must be at least 2, the history not negative")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    placed = (
        turns.withColumn("place", F.row_number().over(order))
        .withColumn("is_system", (F.col("place") == 1) & (F.col("role") == "system"))
        .withColumn("system", F.max(F.when(F.col("is_system"), _piece(F.lit(0)))).over(so_far))
        .withColumn("own", F.when(F.col("is_system"), 0).otherwise(F.col("tokens")))
        .withColumn("before", F.sum("own").over(so_far) - F.col("own"))
    )
    room = F.lit(budget - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0))
    half = F.greatest(F.floor(room / 2), F.lit(1))
    halves = F.floor(F.col("before") / half) * 2 + F.when(F.col("own") > half, 1).otherwise(0)
    cut = placed.withColumn("half", F.when(~F.col("is_system"), halves))
    opened = F.coalesce(F.col("half") != F.lag("half").over(order), F.lit(False))
    cut = cut.withColumn("opens", opened.cast("int"))
    cut = cut.withColumn("window", F.sum("opens").over(so_far))

    no_system = F.lit(None).cast(cut.schema["system"].dataType).alias("system")

    # a turn is history of the windows that the next turns open, while tokens last
    def later(distance: int) -> Column:
        opens = F.lead("opens", distance).over(order) == 1
        near = F.lead("before", distance).over(order) - F.col("before") <= history_tokens
        window = F.lead("window", distance).over(order)
        seen = F.struct(window.alias("window"), F.lit(1).alias("kind"), no_system)
        return F.when(opens & near & ~F.col("is_system"), seen)

    # the turn that opens a window brings the system turn along
    own = F.struct(
        F.col("window"),
        F.when(F.col("is_system"), 0).otherwise(2).alias("kind"),
        F.when(F.col("opens") == 1, F.col("system")).alias("system"),
    )
    cut = cut.withColumn("seen", F.array(own, *(later(d) for d in range(1, history_turns + 1))))
    seen = F.explode(F.array_compact("seen")).alias("seen")
    shown = cut.select("conv_id", "place", "role", "text", "tokens", seen)
    piece = _piece(F.col("seen.kind"))
    windows = (
        shown.select(
            "conv_id", F.col("seen.window").alias("window"), piece.alias("piece"), F.col("seen.system")
        )
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.max("system").alias("system"))
    )
    repeat_system = F.col("system").isNotNull() & (F.col("window") > 0)
    pieces = F.when(repeat_system, F.concat(F.array("system"), F.col("pieces"))).otherwise(F.col("pieces"))
    repeated = F.size(F.filter("pieces", lambda p: p["kind"] == 1)) + repeat_system.cast("int")
    return windows.withColumn("repeated", repeated).withColumn("pieces", pieces).select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
        ).alias("text"),
        _loss(F.col("pieces")).alias("loss"),
        "repeated",
        F.size("pieces").alias("turns"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"),
    )


def _loss(pieces: Column) -> Column:
    """Spans of the new assistant texts, found by adding up lengths."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        learned = p["learned"] & (p["kind"] == 2)
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(learned, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows with what their text says: new_turns (role, text) and loss_texts."""
    parts = F.split("text", F.lit(END))
    whole = F.slice(parts, 1, F.size(parts) - 1)
    # as many as the head of a turn has characters that are not followed by an unescaped colon
    role_of = r"(?s)^### ((?:[^\\:]|\\.)*+): .*$"
    body_of = r"(?s)^### (?:[^\\:]|\\.)*+: (.*)$"
    read = F.transform(
        whole,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, role_of, 1)).alias("role"),
            unescape(F.regexp_extract(t, body_of, 1)).alias("text"),
        ),
    )
    new = F.slice(read, F.col("repeated") + 1, F.size(read))
    learned = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    )
    return windows.withColumn("new_turns", new).withColumn("loss_texts", learned)
