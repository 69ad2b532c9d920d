"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

Each participant of a dialogue gets a rendering of the whole of it in which its own turns are the
assistant's and all others' are those of named users. On request a rendering comes in segments
instead, stretches of turns of which each opens with the dialogue's system turns and tells where in
the rendering it stands, so what one row holds has a bound for dialogues of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.pii import running

#: The parts of a rendered turn.
OPEN, NAMED, BODY, CLOSE = "<|im_start|>", " name=", "\n", "<|im_end|>\n"


def participants(turns: DataFrame) -> DataFrame:
    """(conv, speaker): the distinct speakers of each dialogue; a partial aggregate before the shuffle."""
    return turns.select("conv", "speaker").distinct()


def plain(text: Column) -> Column:
    """text without control marks: `<|` becomes `<\\|`, and a mark so written one backslash more, so
    that no text or name can open or close a turn and each can be read back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def rendered_turn(mine: Column, speaker: Column, text: Column) -> tuple[Column, Column]:
    """(head, body) of a turn: the body, with its closing mark, is what the assistant is trained on.
    Line ends in a name, which would end the head, are spaces."""
    name = F.regexp_replace(plain(speaker), r"[\r\n\x{85}\x{2028}\x{2029}]", " ")
    head = F.concat(F.lit(OPEN), F.when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user" + NAMED), name)), F.lit(BODY))
    return head, F.concat(plain(text), F.lit(CLOSE))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str | None = "system", stretch: int | None = None) -> DataFrame:
    """conv_id, perspective, segment, n_turns, n_own, text and masks of each rendering.

    masks are (start, stop) code points in the text of what is trained on: the bodies of the
    perspective's own turns. Turns by `system` are rendered as system turns for everyone, are never
    trained on, and give no perspective; a dialogue of system turns alone gives no rows. Control
    marks in texts and names are escaped (see plain).

    Without `stretch` each rendering is one row, of segment 0. With it, a segment holds that many
    turns in order, none of them a system turn, after all the dialogue's system turns up to there;
    turns are numbered by a window over the dialogue, which Spark sorts and spills, and segments
    without a turn of the perspective's own are kept, as context, with no masks.

    Turns stand by turn number, ties by speaker, then text; rows that repeat are repeated turns. A
    null turn number stands first. A null speaker is the participant 'unknown', a null text is
    empty. Rows of null conv_id form one dialogue. An empty table gives no rows; other columns are
    ignored.
    """
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_system = F.col("speaker").eqNullSafe(F.lit(system))
    who = participants(turns.where(~is_system)).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective"))
    # a row per turn and perspective is the result itself; the speakers of a dialogue are few and
    # join its turns before those are rendered, so a turn's text is shuffled once
    listed = F.struct("turn", "speaker", "text")
    if stretch is None:
        part = turns.groupBy("conv").agg(F.array_sort(F.collect_list(listed)).alias("turns")).withColumn("segment", F.lit(0).cast("long"))
    else:
        order = Window.partitionBy("conv").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
        number = F.sum((~is_system).cast("long")).over(order)
        cut = turns.withColumn("segment", F.greatest(F.floor((number - 1) / stretch), F.lit(0)).cast("long"))
        own = cut.where(~is_system).groupBy("conv", "segment").agg(F.collect_list(listed).alias("own"))
        first = cut.where(is_system).groupBy(F.col("conv").alias("c"), F.col("segment").alias("since")).agg(F.collect_list(listed).alias("s"))
        seen = own.select("conv", "segment").join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("since") <= F.col("segment")))
        seen = seen.groupBy(F.col("conv").alias("c"), F.col("segment").alias("at")).agg(F.flatten(F.collect_list("s")).alias("system"))
        both = own.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("at")), "left")
        none = F.array().cast(f"array<{turns.select(listed.alias('x')).schema['x'].dataType.simpleString()}>")
        part = both.select("conv", "segment", F.concat(F.array_sort(F.coalesce("system", none)), F.array_sort("own")).alias("turns"))
    own = part.join(who, F.col("conv").eqNullSafe(F.col("c")))

    def piece(t: Column) -> Column:
        mine = t["speaker"] == F.col("perspective")
        head, body = rendered_turn(mine, t["speaker"], t["text"])
        head = F.when(t["speaker"].eqNullSafe(F.lit(system)), F.lit(OPEN + "system" + BODY)).otherwise(head)
        return F.struct(head.alias("head"), body.alias("body"), mine.alias("mine"))

    rows = own.select(F.col("conv").alias("conv_id"), "perspective", "segment", F.transform("turns", piece).alias("p"))
    length = lambda c: F.char_length(c).cast("long")
    stops = running(F.transform("p", lambda p: length(p["head"]) + length(p["body"])), lambda a, b: a + b)
    spans = F.zip_with("p", stops, lambda p, s: F.struct((s - length(p["body"])).alias("start"), s.alias("stop"), p["mine"].alias("mine")))
    masks = F.transform(F.filter(spans, lambda x: x["mine"]), lambda x: F.struct(x["start"], x["stop"]))
    return rows.select(
        "conv_id", "perspective", "segment", F.size("p").cast("long").alias("n_turns"), F.size(F.filter("p", lambda p: p["mine"])).cast("long").alias("n_own"),
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), masks.alias("masks"),
    )
