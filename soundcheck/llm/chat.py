"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

Chat logs often store a conversation again after every turn. Each turn gets the hash of its
conversation up to there (the exclusive-or of 128-bit hashes of position, role and text, so that it
is a running aggregate). A conversation whose last hash occurs inside a longer one is a snapshot of
it and goes; of equal conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from soundcheck.plans.ordered import over_groups, row_number
from soundcheck.session import materialise

TURNS_PER_PART = 512


def turn_hash(salt: str) -> Column:
    """64 bits of one turn at its place; nulls differ from empty strings."""
    return F.xxhash64(F.lit(salt), F.col("pos"), F.isnull("role"), F.coalesce("role", F.lit("")),
                      F.isnull("text"), F.coalesce("text", F.lit("")))


def prefixes(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Adds pos (from 1), part, and h1, h2: the hash of the conversation up to and including the turn.

    Positions follow (turn, role, text), so equal turn numbers have a fixed order and repeated rows
    stay repeated. A conversation may be longer than a task should hold: ``over_groups`` numbers its
    turns across blocks, and hashes run within parts, then across the parts.
    """
    numbered = over_groups(turns, ["conv_id"], [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")],
                           [row_number("pos")])
    hashed = numbered.select("*", turn_hash("a").alias("t1"), turn_hash("b").alias("t2"),
                             F.floor((F.col("pos") - 1) / turns_per_part).cast("long").alias("part"))
    inside = Window.partitionBy("conv_id", "part").orderBy("pos")
    local = materialise(hashed.select("conv_id", "pos", "part", "role", "text", F.bit_xor("t1").over(inside).alias("l1"),
                                      F.bit_xor("t2").over(inside).alias("l2")), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = local.groupBy("conv_id", "part").agg(
        F.max_by("l1", "pos").alias("p1"), F.max_by("l2", "pos").alias("p2"), F.max("pos").alias("upto"))
    longer = whole.where("part > 0").select("conv_id").distinct()
    carried = whole.join(longer, "conv_id", "left_semi").select(
        "conv_id", "part", F.bit_xor("p1").over(before).alias("c1"), F.bit_xor("p2").over(before).alias("c2"))
    return local.join(carried, ["conv_id", "part"], "left").select(
        "conv_id", "pos", "part", "role", "text",
        F.col("l1").bitwiseXOR(F.coalesce("c1", F.lit(0).cast("long"))).alias("h1"),
        F.col("l2").bitwiseXOR(F.coalesce("c2", F.lit(0).cast("long"))).alias("h2"))


def maximal(marked: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that are no prefix of a longer one.

    Equal conversations are one group, counted map-side; the prefixes they are compared with are
    distinct, so neither side of the anti join has a hot key.
    """
    ends = marked.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "pos").alias("h"))
    kept = ends.groupBy("n_turns", "h.h1", "h.h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = marked.join(ends.select("conv_id", "n_turns"), "conv_id").where("pos < n_turns").select(
        F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return kept.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """conv_id, part, n_turns (of the whole conversation), copies, rendered.

    ``rendered`` holds up to ``turns_per_part`` turns, each as ``<|im_start|>role\\ntext<|im_end|>\\n``;
    the parts of a conversation in order are its full text, so no row grows without bound. A null
    conversation id is not a conversation: such rows are left out. A null role renders as ``user``
    and a null text as empty, but they hash apart from those. Repeated rows are repeated turns. An
    empty table gives no rows. Only the four named columns are read.
    """
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                                 F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("conv_id IS NOT NULL")
    marked = materialise(prefixes(turns, turns_per_part), "prefixes")
    shown = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"),
                     F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = marked.select("conv_id", "part", "pos", shown.alias("line")).join(maximal(marked), "conv_id")
    return rows.groupBy("conv_id", "part", "n_turns", "copies").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("rendered"))
