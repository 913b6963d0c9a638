"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others
as named users. Turns of a system role open or stay as system turns in every rendering and are no participant.
Each rendering has the character spans that a loss counts: the text and the closing mark of the assistant's turns.

Turns are ordered by turn, role and text; equal rows are all rendered. A null turn comes first, a null role is the
participant ``unknown``, a null text is empty. Marks within texts and names are defused. A conversation of more than
``part_turns`` turn numbers is rendered in parts of that many, so no task ever holds a whole endless dialogue.
Null conversation ids form one conversation. A conversation with system turns only gives no rows, as do empty tables.
Only the four named columns are read. All work is DataFrame operations; offsets are running sums within a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 1024
SYSTEM_ROLES = ("system",)
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS, system_roles: tuple[str, ...] = SYSTEM_ROLES,
                        id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, participant, n_turns, text, mask_starts, mask_ends: one row per participant and part."""
    safe = lambda c: F.replace(c, F.lit(OPEN), F.lit("< |"))
    t = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.floor(F.greatest(F.col(turn_col), F.lit(0)) / part_turns), F.lit(0)).cast("long").alias("part"),
                     safe(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("role"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    people = t.filter(~F.col("role").isin(*system_roles)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("participant")).distinct()
    d = t.join(people, t["conv_id"].eqNullSafe(people["_conv"])).drop("_conv")
    own = F.col("role") == F.col("participant")
    head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).when(F.col("role").isin(*system_roles), F.lit("system")).otherwise(
        F.concat(F.lit("user name="), F.col("role"))), F.lit(CLOSE + "\n"))
    d = d.select("conv_id", "part", "participant", "turn", "role", "text", own.alias("own"), head.alias("head"))
    d = d.withColumn("size", F.length("head") + F.length("text") + len(END) + 1)
    group = ["conv_id", "part", "participant"]
    before = Window.partitionBy(*group).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    d = d.withColumn("seg", F.struct("at", F.concat("head", "text", F.lit(END + "\n")).alias("s"), "own",
                                     (F.col("at") + F.length("head")).alias("from"), (F.col("at") + F.col("size") - 1).alias("to")))
    d = d.groupBy(*group).agg(F.sort_array(F.collect_list("seg")).alias("segs"))
    masked = F.filter("segs", lambda s: s["own"])
    return d.select(*group, F.size("segs").cast("long").alias("n_turns"), F.array_join(F.transform("segs", lambda s: s["s"]), "").alias("text"),
                    F.transform(masked, lambda s: s["from"]).alias("mask_starts"), F.transform(masked, lambda s: s["to"]).alias("mask_ends"))
