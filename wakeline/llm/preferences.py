"""Preference pairs: a common prompt, rendered once, and two masked completions.

Turns of a chosen and of a rejected conversation are aligned by number.  The
prompt is the longest run of turns from the first on that are equal in both,
roles and texts alike; the rest of each conversation is its completion.  What
comes out is a row a pair: prompt, chosen and rejected completion side by side,
and for each completion the spans of characters that count in the loss, which
are the texts and end marks of the trained roles.  A conversation of more than
``part_turns`` turn numbers goes on in further rows, its ordered parts; in a
part, spans count from the part's begin.

All work is in DataFrame functions.  Where the prompt ends is found on digests
of turns, by grouped minima that Spark combines before the shuffle; texts are
then grouped once.  Pairs that hold over a thousandth of all turns learn their
prompt's end apart from the others, and a row never holds more than a part.

A null text renders as empty and equals an empty one; a null role renders as
``unknown``; turns without number or pair are left out.  Repeated turns count
once; different texts under one number are ordered by role, then text.  A pair
of which one side is missing has no prompt.  Long texts are rendered whole;
other columns are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import stored, with_group

#: Turn numbers of a part; conversations that stand in one ring.
PART_TURNS, RING = 1_000, 128
SIDES = ("prompt", "chosen", "rejected")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _body(text: Column) -> Column:
    return F.concat(text, F.lit("<|end|>\n"))


def _plain(turns: DataFrame, turn_col: str, role_col: str, text_col: str, **more: Column) -> DataFrame:
    return turns.select(*[c.alias(n) for n, c in more.items()], F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def prompt_ends(rows: DataFrame) -> DataFrame:
    """pair_id, first_other (the first turn that differs; null for none), turns (number of rows)."""
    said = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    by_turn = rows.select("pair_id", "turn", F.when(F.col("chosen"), said).alias("c"), F.when(~F.col("chosen"), said).alias("r"))
    by_turn = by_turn.groupBy("pair_id", "turn").agg(F.sort_array(F.collect_set("c")).alias("c"), F.sort_array(F.collect_set("r")).alias("r"), F.count("*").alias("n"))
    return by_turn.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("first_other"), F.sum("n").alias("turns"))


def _mask(turns: Column, trained: tuple[str, ...]) -> Column:
    """Spans of the trained roles' texts and end marks in the rendered turns; a part's turns are few."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(_head(x["role"]))
        end = start + F.char_length(_body(x["text"]))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"].isin(*trained), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",), part_turns: int = PART_TURNS) -> DataFrame:
    """pair_id, part, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``chosen``: whether a turn belongs to the chosen conversation of its pair.
    """
    rows = _plain(turns, turn_col, role_col, text_col, pair_id=pair, chosen=chosen).where("pair_id IS NOT NULL AND turn IS NOT NULL AND chosen IS NOT NULL")
    ends = stored(prompt_ends(rows), "ends")
    total = ends.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    rows = with_group(rows, ends, ["pair_id"], "turns", total)
    shared = F.col("first_other").isNull() | (F.col("turn") < F.col("first_other"))
    side = F.when(shared, F.when(F.col("chosen"), "prompt")).when(F.col("chosen"), "chosen").otherwise("rejected")
    rows = rows.select("pair_id", F.floor(F.col("turn") / part_turns).alias("part"), side.alias("side"), F.struct("turn", "role", "text").alias("said"))
    own = [F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("said")))).alias(s) for s in SIDES]
    # a shared turn is taken from the chosen side alone
    parts = rows.where("side IS NOT NULL").groupBy("pair_id", "part").agg(*own)
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat(_head(x["role"]), _body(x["text"]))), "")
    return parts.select("pair_id", "part", *[text(F.col(s)).alias(s) for s in SIDES], *[_mask(F.col(s), trained).alias(f"{s}_mask") for s in SIDES[1:]])


def with_other_replies(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", seed: int = 17, ring: int = RING) -> DataFrame:
    """Rejected conversations for a table of plain ones: pair_id, chosen, turn, role, text.

    Each conversation is the chosen one of its pair.  Its rejected one has the
    same turns before the last one of the assistant, and in place of that one
    the last reply of another conversation: the next one in a ring of about
    ``ring`` conversations in a seeded order.  A conversation without a reply,
    or alone in its ring, is rejected as it is.
    """
    rows = _plain(turns, turn_col, role_col, text_col, conv=F.col(conv_col)).where("conv IS NOT NULL AND turn IS NOT NULL")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("cut")
    cuts = stored(rows.groupBy("conv").agg(last, F.count("*").alias("turns"), F.sha2(F.concat(F.col("conv").cast("string"), F.lit(f":{seed}")), 256).alias("place")), "cuts")
    replies = cuts.where("cut IS NOT NULL")
    total, answered = cuts.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.count("cut")).first()
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % (answered // ring + 1)
    line = Window.partitionBy("ring").orderBy("place", "conv")
    all_ = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of each conversation the one before it, whose rejected reply it gives
    before = lambda c: F.coalesce(F.lag(c).over(line), F.last(c).over(all_))
    given = replies.withColumn("ring", number).select("conv", before("conv").alias("to"), before("cut").alias("at"))
    known = stored(cuts.drop("place").join(given, "conv", "left"), "rings")
    rows = with_group(rows, known, ["conv"], "turns", total)
    as_ = lambda pair, chosen, turn: F.struct(F.col(pair).alias("pair_id"), F.lit(chosen).alias("chosen"), F.col(turn).alias("turn"))
    plays = F.array(
        as_("conv", True, "turn"),
        F.when(F.col("cut").isNull() | (F.col("turn") < F.col("cut")), as_("conv", False, "turn")),
        F.when((F.col("turn") == F.col("cut")) & (F.col("role") == "assistant"), as_("to", False, "at")),
    )
    return rows.select(F.explode(F.array_compact(plays)).alias("p"), "role", "text").select("p.*", "role", "text")
