"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Every
span becomes one training window: the system turn, a few turns of history, and
the span's own turns. Only assistant turns of the span itself carry loss, so a
target that is repeated as history is masked there.

A window keeps to its budget: turns longer than a quarter of it stand alone,
shorter ones share spans of less than half of it, and what is repeated gets the
rest, the system turn first, then the nearest turns. The one exception is a turn
that alone exceeds the budget: it is kept whole, in a window without context.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles
and texts a backslash is doubled and ``<|`` becomes ``<\\|``; so no control string
can come from a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortmill.llm import base

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: Tokens per window, of which history may use ``HISTORY_TURNS`` turns; tokens a turn has besides its words.
BUDGET, HISTORY_TURNS, TURN_TOKENS = 512, 2, 4
#: Turn numbers per block of the prefix sums.
BLOCK_TURNS = 1024


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """Exact: ``<``, one backslash, ``|`` only comes from ``<|``; all other backslashes are doubled."""
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str, room: int) -> DataFrame:
    """Turns with their number ``rn`` (from 1), the tokens and the long turns (beyond ``room``) before them, by conversation.

    Rows stand by turn (null first), role, text; null roles and texts are empty.
    Sums are taken in blocks of turn numbers, so a long conversation is not
    counted in one task; equal rows are interchangeable.
    """
    texts = F.coalesce(base.named(text), F.lit(""))
    rows = turns.select(
        base.named(conv).alias("conv"), F.struct(base.named(conv)).alias("c"), base.named(turn).alias("turn"),
        F.coalesce(base.named(role), F.lit("")).alias("role"), texts.alias("text"),
        (F.regexp_count(texts, F.lit(base.WORD)) + TURN_TOKENS).cast("bigint").alias("tokens"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 40))))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    rows = rows.withColumn("long", (F.col("tokens") > room).cast("int"))
    blocks = rows.groupBy("c", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("long").alias("l")).select(
        "c", "block", F.coalesce(F.sum("n").over(before), zero).alias("n0"),
        F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.coalesce(F.sum("l").over(before), zero).alias("l0"))
    inside = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(blocks, ["c", "block"]).select(
        "c", "conv", "role", "text", "tokens", "long", (F.col("n0") + F.row_number().over(inside)).alias("rn"),
        (F.col("t0") + F.sum("tokens").over(upto) - F.col("tokens")).alias("before"),
        (F.col("l0") + F.sum("long").over(upto) - F.col("long")).alias("longs"))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv, window, tokens, context, formatted, spans.

    A quarter of the budget is a span's room: a turn of up to that size belongs
    to the span in which its first token falls, so no turn is cut and a span has
    less than half of the budget; a longer turn is a span of its own. The rest
    of the budget goes to the system turn, if the conversation's first turn is
    one, and then to the up to ``history`` turns before, nearest first, as long
    as they fit. ``window`` orders a conversation's windows. ``tokens`` exceeds
    the budget only where a single turn does. ``context`` counts the leading
    turns that are repeated (system turn, history). ``spans`` are the loss
    ranges of ``formatted`` in code points, end exclusive.
    """
    room = max(1, budget // 4)
    rows = numbered(turns, conv, turn, role, text, room).withColumn("window", F.struct(
        F.floor(F.col("before") / room).alias("room"), "longs", "long"))
    piece = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), escape(F.col("text")), F.lit(END))
    head = F.length(escape(F.col("role"))) + len(START) + len(SEP)
    rows = base.stored(rows.select(
        "c", "conv", "window", "rn", "tokens", (F.col("role") == "assistant").alias("target"),
        ((F.col("rn") == 1) & (F.col("role") == "system")).alias("system"),
        piece.alias("piece"), head.alias("head")), "chat-turns")

    first = rows.groupBy("c", "window").agg(F.min("rn").alias("first")).filter("first > 1")
    repeated = first.select("c", F.col("window").alias("to")).join(rows.filter("system").drop("window"), "c")
    if history:
        wanted = first.select("c", F.col("window").alias("to"), F.explode(F.sequence(
            F.greatest(F.lit(1), F.col("first") - history), F.col("first") - 1)).alias("rn"))
        repeated = repeated.unionByName(wanted.join(
            rows.filter(~F.col("system") & (F.col("tokens") <= budget)), ["c", "rn"]).select(*repeated.columns))
    parts = rows.select("c", "conv", "window", F.struct(
        F.lit(True).alias("own"), "rn", "piece", "head", "target", "system", "tokens").alias("part")).unionByName(
        repeated.select("c", "conv", F.col("to").alias("window"), F.struct(
            F.lit(False).alias("own"), "rn", "piece", "head", F.lit(False).alias("target"), "system", "tokens").alias("part")))
    # A window's turns are bounded by the budget, as each has at least TURN_TOKENS tokens.
    whole = parts.groupBy("c", "window").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list("part")).alias("parts"))
    size = lambda some: F.aggregate(some, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"])
    whole = whole.withColumns({"own": F.filter("parts", lambda x: x["own"]),
                               "near": F.filter("parts", lambda x: ~x["own"] & ~x["system"])})
    whole = whole.withColumn("lead", F.filter("parts", lambda x: ~x["own"] & x["system"] & (
        x["tokens"] <= F.lit(budget) - size(F.col("own")))))
    whole = whole.withColumn("rest", F.lit(budget) - size(F.col("own")) - size(F.col("lead")))
    whole = whole.withColumn("near", F.filter("near", lambda x: size(F.filter(
        "near", lambda y: y["rn"] >= x["rn"])) <= F.col("rest")))
    whole = whole.withColumn("parts", F.concat("lead", "near", "own"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["piece"])
        span = F.struct((acc["at"] + x["head"]).alias("start"), (end - len(END)).alias("end"))
        return F.struct(end.alias("at"), F.when(x["target"], F.concat(acc["spans"], F.array(span))).otherwise(
            acc["spans"]).alias("spans"))

    return whole.select(
        "conv", "window", size(F.col("parts")).alias("tokens"), (F.size("lead") + F.size("near")).alias("context"),
        F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("formatted"),
        F.aggregate("parts", nothing, add)["spans"].alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    pieces = F.split(formatted, r"<\|im_end\|>", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, SEP, 1), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substring_index(p, SEP, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from ``windows``, per conversation.

    The digests run over a whole conversation, so its text meets in one row here.
    """
    own = F.slice(read_back(F.col("formatted")), F.col("context") + 1, F.size(read_back(F.col("formatted"))))
    read = formatted.select(F.struct("conv").alias("c"), F.struct(
        "window", own.alias("turns"), loss_text(F.col("formatted"), F.col("spans")).alias("loss")).alias("w"),
        F.length("formatted").alias("chars"))
    joined = read.groupBy("c").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("chars"))
    lines = F.array_join(F.transform(F.flatten(F.col("w.turns")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("w.loss"), "")
    return joined.select(
        F.col("c.conv").alias("conv_id"), F.size(F.flatten(F.col("w.turns"))).cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.col("chars").cast("bigint").alias("formatted_chars"))
