"""Chat formatting by rotating the perspective.

For every participant of a dialogue the whole dialogue is rendered with that speaker as
assistant and the others as named users; masks cover what the assistant says, with its end mark.
Turns of the role ``system`` speak to everyone and belong to no participant.

A row holds at most BLOCK turns in their order, so a dialogue of any length is many bounded rows: turn
numbers divided by BLOCK give ``part``, and a part with more turns than that (equal or missing numbers)
is cut by rank into rows numbered by ``piece``.  Such ranks come from one sort of those turns alone,
dealt over tasks by range, never from a window over a dialogue.  Mask spans count characters of their
own row.  DataFrame functions only.

Cases: null texts are empty, texts of any length stay whole; a null role is the speaker ``unknown``; a
null turn comes first; turns with equal numbers are ordered by role and text, repeated ones stay; control
marks inside texts and names are defused; a dialogue with nobody but the system is rendered once, without
a participant; other columns, whatever their names, are left out; empty tables give empty results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .scratch import stored

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"


def _defused(text: Column) -> Column:
    """Text whose control marks cannot be taken for ours."""
    return F.regexp_replace(F.regexp_replace(text, r"<\|", "<¦"), r"\|>", "¦>")


def _pieces(said: DataFrame, block: int) -> DataFrame:
    """The turns with the piece of their part, by rank within a part that holds more than a block."""
    zero = F.lit(0).cast("long").alias("piece")
    full = stored(said.groupBy("conv_id", "part").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("conv_id").alias("of"), F.col("part").alias("of_part")), "chat-full")
    if full.isEmpty():
        return said.select("*", zero)
    mine = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    few = said.join(full, mine, "left_anti").select("*", zero)
    # equal turns get numbers that are kept, so that they too are dealt over tasks, and alike if one is run again
    many = stored(said.join(full, mine, "left_semi").withColumn("salt", F.rand()), "chat-many")
    order = ("conv_id", "part", "t", "salt")
    ranked = stored(many.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "chat-ranked")
    task, seen = F.shiftright("id", 33), 0
    before = {}
    for k, n in sorted((r[0], r[1]) for r in ranked.groupBy(task).agg(F.count("*")).collect()):  # a row for each task
        before[k], seen = seen, seen + n
    place = F.element_at(F.from_json(F.lit(json.dumps(before)), "map<string,bigint>"), task.cast("string")) + F.col("id").bitwiseAND((1 << 33) - 1)
    placed = ranked.withColumn("place", place)
    first = stored(placed.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("of_part")).agg(F.min("place").alias("first")), "chat-first")
    piece = F.floor((F.col("place") - F.col("first")) / block).cast("long").alias("piece")
    return few.unionByName(placed.join(first, mine).select("conv_id", "part", "t", piece))


def rotate(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, participant, part, piece, n_turns, rendered, mask): mask holds [start, end) spans within rendered."""
    name = F.coalesce(F.col(role).cast("string"), F.lit("unknown"))
    number = F.col(turn).cast("long")
    said = df.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.floor(number / block).cast("long"), F.lit(-1 << 40)).alias("part"),
        F.struct(number.alias("turn"), name.alias("role"), _defused(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).alias("t"),
    )
    blocks = _pieces(said, block).groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = blocks.select(F.col("conv_id").alias("of"), F.explode(F.array_distinct(F.col("turns.role"))).alias("participant")).where("participant <> 'system'").distinct()
    both = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    assistant = lambda t: F.coalesce(t["role"] == F.col("participant"), F.lit(False))
    head = lambda t: F.when(t["role"] == "system", "system").when(assistant(t), "assistant").otherwise(F.concat(F.lit("user name="), _defused(t["role"])))
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), head(t), F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), assistant(t).alias("learn")))
    cut = both.withColumn("pieces", pieces)
    whole = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return cut.select("conv_id", "participant", "part", "piece", F.size("turns").cast("long").alias("n_turns"), F.array_join(whole, "").alias("rendered"), F.aggregate("pieces", zero, step, lambda acc: acc["spans"]).alias("mask"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return out.select("conv_id", "participant", "part", "piece", "n_turns", "rendered", spans.alias("mask_spans"))


_ORACLE = """
WITH said AS (
  SELECT conv_id, turn, role, text, part, CAST(floor((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, text) - 1) / 256) AS BIGINT) AS piece
  FROM (SELECT conv_id, turn, role, replace(replace(text, '<|', '<¦'), '|>', '¦>') AS text, turn // 256 AS part FROM conversations)
), speakers AS (
  SELECT DISTINCT conv_id, role AS participant FROM said WHERE role <> 'system'
), both_ AS (
  SELECT s.conv_id, p.participant, s.part, s.piece, s.turn, s.role, s.text,
         '<|im_start|>' || CASE WHEN s.role = 'system' THEN 'system' WHEN s.role = p.participant THEN 'assistant'
                                ELSE 'user name=' || s.role END || chr(10) AS head,
         s.text || '<|im_end|>' AS body, coalesce(s.role = p.participant, false) AS learn
  FROM said s LEFT JOIN speakers p USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part, piece ORDER BY turn, role, text
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start_
  FROM both_
)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, piece, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(CAST(CAST(start_ AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start_ + length(body) AS BIGINT) AS VARCHAR), ' '
                           ORDER BY turn, role, text) FILTER (WHERE learn), '') AS mask_spans
FROM placed GROUP BY conv_id, participant, part, piece
"""

QUERIES = {"op4_chat": op4_chat}
ORACLE_SQL = {"op4_chat": _ORACLE}
