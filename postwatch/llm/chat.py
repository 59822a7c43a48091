"""Chat formatting into budgeted windows with a loss mask, in DataFrame functions alone.

A conversation's turns, in the order of turn, role and text, are laid end to end in tokens.  Prefix sums of
the turns' tokens choose the windows: the conversation is ruled into blocks of as many tokens as the budget
leaves beside the system turn and the history; the turns that lie inside a block are one window, and a turn
that reaches over a block's end is a window of its own.  So windows consist of whole turns, are found from
prefix sums alone, and keep to the budget unless a single turn is over it.  Each window starts with the
conversation's system turn and the last turns before it that fit in ``HISTORY`` tokens; these are repeated
and masked.  The loss covers each assistant text once, in the window whose own turn it is.

Template: ``<|turn|>role<|text|>text</s>`` per turn.  Inside roles and texts a backslash is doubled, and the
control strings get a backslash and a hyphen after their first character, so no control string is left
there; ``unescaped`` takes that back.

Prefix sums are made in two levels, within runs of ``CHUNK`` turn numbers and over the runs, so that a
very long conversation is spread over tasks.

Defined results: a null text or role is empty; null ids form one conversation; null turn numbers come
first; repeated rows are turns of their own; a conversation's first turn is its system turn if its role is
``system``; a conversation of a system turn alone is one window of this turn; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwatch.llm.common import keep, keyed_join

BUDGET = 512
HISTORY = 96
#: Tokens of the template around a turn.
FRAME = 4
CHUNK = 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
#: The control strings that must not occur in texts.
CONTROL = r"\\|<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"
WORD = r"[^\x20\x09-\x0D]+"


def escaped(x: Column) -> Column:
    # A control string's first character, or a backslash, is followed by the mark.
    doubled = F.regexp_replace(x, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))", r"$1\\-")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(?:-|(\\))", "$1")


def tokens(x: Column) -> Column:
    """Tokens of a text as the budget counts them: words."""
    return F.regexp_count(x, F.lit(WORD))


def turns(
    rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, count=tokens
) -> DataFrame:
    """``(conv, i, role, text, n, start, system_n)``: place, tokens and prefix sum of each turn."""
    base = rows.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    number = F.floor(F.col("turn") / F.lit(CHUNK))
    base = base.withColumn("chunk", F.coalesce(number.cast("long"), F.lit(-(1 << 62)))).withColumn(
        "n", (count(F.col("text")) + FRAME).cast("long")
    )
    inside = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "n").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = keep(
        base.withColumn("i", F.count("*").over(inside)).withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))),
        "turns",
    )
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("conv").orderBy("chunk")
    chunks = (
        numbered.groupBy("conv", "chunk")
        .agg(
            F.count("*").alias("rows"), F.sum("n").alias("total"),
            F.max(F.when((F.col("i") == 0) & (F.col("role") == "system"), F.col("n"))).alias("head"),
        )
        .select(
            F.col("conv").alias("c_conv"), F.col("chunk").alias("c_chunk"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("c_rows"),
            F.coalesce(F.sum("total").over(before), F.lit(0)).alias("c_start"),
            F.coalesce(F.first("head").over(first), F.lit(0)).alias("system_n"),
        )
    )
    joined = keyed_join(
        numbered, keep(chunks, "chunks"), [("conv", "c_conv"), ("chunk", "c_chunk")], ["i", "n", "text"], "inner"
    )
    return joined.select(
        "conv", (F.col("c_rows") + F.col("i")).alias("i"), "role", "text", "n",
        (F.col("c_start") + F.col("start")).alias("start"), "system_n",
    )


def windows(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    count=tokens,
) -> DataFrame:
    """One row per window: ``(conv, window, formatted, repeated, loss, n_tokens, over)``.

    ``repeated`` is the number of turns at the window's start that others own (system turn and history),
    ``loss`` the spans of ``formatted``, start and length in code points, that count, ``over`` whether the
    window is over the budget.
    """
    placed = turns(rows, id_col, turn_col, role_col, text_col, count)
    is_system = (F.col("system_n") > 0) & (F.col("i") == 0)
    # Positions are counted after the system turn; at least a quarter of the budget is left for a window.
    room = F.greatest(F.lit(budget - history) - F.col("system_n"), F.lit(max(1, budget // 4)))
    at = F.col("start") - F.col("system_n")
    block = F.floor(at / room)
    over_end = F.floor((at + F.col("n") - 1) / room) > block
    owned = keep(
        placed.withColumn("at", at)
        .withColumn("room", room)
        .withColumn("is_system", is_system)
        .withColumn("window", F.when(is_system, F.lit(-1)).otherwise(2 * block + over_end.cast("int")).cast("long")),
        "owned",
    )
    rest = owned.filter("NOT is_system")
    begin = rest.groupBy(F.col("conv").alias("b_conv"), F.col("window").alias("b_window")).agg(
        F.min("at").alias("begin")
    )
    # A turn can be history of windows that begin at most HISTORY tokens after its own start.
    blocks = F.sequence(F.floor(F.col("at") / F.col("room")), F.floor((F.col("at") + history) / F.col("room")))
    later = F.filter(
        F.flatten(F.transform(blocks, lambda b: F.array(2 * b, 2 * b + 1))), lambda w: w > F.col("window")
    ).cast("array<bigint>")
    repeats = keyed_join(
        rest.filter(F.col("n") <= history).withColumn("to", F.explode(later)),
        keep(begin, "begins"), [("conv", "b_conv"), ("to", "b_window")], ["i"], "inner",
    ).filter(F.col("begin") - F.col("at") <= history)
    columns = ["conv", "window", "i", "role", "text", "n", "own"]
    parts = rest.withColumn("own", F.lit(True)).select(*columns).unionAll(
        repeats.withColumn("own", F.lit(False)).withColumn("window", F.col("to")).select(*columns)
    )
    shown = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    piece = F.struct(
        "i", shown.alias("head"), escaped(F.col("text")).alias("body"),
        ((F.col("role") == "assistant") & F.col("own")).alias("counts"), "own", "n",
    )
    gathered = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list(piece)).alias("t"))
    systems = keep(
        owned.filter("is_system").select(
            F.col("conv").alias("s_conv"), F.concat(shown, escaped(F.col("text")), F.lit(END)).alias("s_shown"),
            F.col("n").alias("s_n"),
        ),
        "systems",
    )
    joined = keyed_join(gathered, systems, [("conv", "s_conv")], ["window"])
    # A conversation of a system turn alone.
    alone = keyed_join(systems, keep(begin.select(F.col("b_conv").alias("x")).distinct(), "begun"), [("s_conv", "x")], ["s_n"], "left_anti")
    empty = F.array().cast(gathered.schema["t"].dataType)
    joined = joined.select("conv", "window", "t", "s_shown", "s_n").unionAll(
        alone.select(F.col("s_conv"), F.lit(0).cast("long"), empty, "s_shown", "s_n")
    )
    # The system turn belongs to the window of the turn after it.
    owns_system = (F.size("t") == 0) | F.exists("t", lambda x: x["own"] & (x["i"] == 1))
    whole = F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    sizes = F.transform("t", lambda x: F.struct(
        F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), x["counts"].alias("counts")
    ))
    lead = F.length(F.coalesce(F.col("s_shown"), F.lit("")))
    span = "array<struct<start:int,size:int>>"
    walked = F.aggregate(
        sizes,
        F.struct(lead.alias("at"), F.array().cast(span).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["head"] + x["body"] + len(END)).alias("at"),
            F.when(
                x["counts"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("size")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    n_tokens = F.aggregate("t", F.coalesce(F.col("s_n"), F.lit(0)), lambda a, x: a + x["n"])
    return joined.select(
        "conv", "window",
        F.concat(F.coalesce(F.col("s_shown"), F.lit("")), F.array_join(whole, "")).alias("formatted"),
        (
            F.size(F.filter("t", lambda x: ~x["own"]))
            + F.when(F.col("s_shown").isNotNull() & ~owns_system, 1).otherwise(0)
        ).alias("repeated"),
        walked["spans"].alias("loss"), n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv, window, turns, losses)``: turns that a window owns, and the texts under the mask, unescaped."""
    parts = F.transform(
        F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != ""),
        lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), r"<\|text\|>"),
    )
    own = F.slice(parts, F.col("repeated") + 1, F.size(parts))
    return formatted.select(
        "conv", "window",
        F.transform(own, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["size"]))).alias("losses"),
        F.length("formatted").cast("long").alias("chars"),
    )
