"""Perspective rotation of many-party dialogues: every participant once as the assistant.

DataFrame functions only. For each conversation and each of its participants the whole dialogue is
rendered with that speaker as assistant and all others as named users; system turns keep their
role and are no participant. A rendered dialogue is as long as its conversation, so it is returned
turn by turn with the place of each turn's characters, and the span of them that is trained on:
the assistant's text with its closing mark.

Places are sums over what comes before. Turns are cut into ranges of TURNS numbers; sums are taken
in each range, and over the ranges' totals, so that a very long conversation is spread over tasks.

Defined results: a null speaker is "unknown"; a null text is empty; null turns come first, as one
range; turns with one number go by speaker and text; repeated rows are rendered as often; rows
without conv_id are one conversation; a conversation of system turns only gives no rows, as does an
empty table; further columns are ignored. Marks inside a text are kept: the spans tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in a range.
TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_NO_TURN = -(2**62)


def header(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker == perspective, F.lit(f"{OPEN}assistant\n"))
        .when(speaker == "system", F.lit(f"{OPEN}system\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))
    )


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, position, turn, speaker, rendered, start, length, mask_start, mask_end (both null if untrained)."""
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col(turn).cast("long"), F.lit(_NO_TURN)) / F.lit(TURNS)).alias("range"),
    )
    other = F.length(header(F.col("speaker"), F.lit(None).cast("string")))
    # What a range adds for a perspective: all turns as others', and the difference for its own.
    by_speaker = said.groupBy("conv_id", "range", "speaker").agg(
        F.count("*").alias("n"), F.sum(other + F.length("text") + F.lit(len(CLOSE) + 1)).alias("chars")
    )
    ranges = by_speaker.groupBy("conv_id", "range").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    people = by_speaker.where("speaker <> 'system'").select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    own = by_speaker.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), F.col("speaker").alias("_p"), F.col("n").alias("_n"))
    less = F.length(header(F.col("perspective"), F.lit(None).cast("string"))) - F.lit(len(f"{OPEN}assistant\n"))
    grid = ranges.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    grid = grid.join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")) & (F.col("perspective") == F.col("_p")), "left")
    before = Window.partitionBy("conv_id", "perspective").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(
        F.col("conv_id").alias("_c"),
        F.col("range").alias("_r"),
        "perspective",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("position0"),
        F.coalesce(F.sum(F.col("chars") - F.coalesce("_n", F.lit(0)) * less).over(before), F.lit(0)).alias("start0"),
    )
    rows = said.join(grid, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
    rows = rows.withColumn("head", header(F.col("speaker"), F.col("perspective")))
    rows = rows.withColumn("rendered", F.concat("head", "text", F.lit(CLOSE + "\n")))
    within = Window.partitionBy("conv_id", "range", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    trained = F.col("speaker") == F.col("perspective")
    rows = rows.withColumn("position", F.col("position0") + F.row_number().over(within) - 1).withColumn(
        "start", F.col("start0") + F.coalesce(F.sum(F.length("rendered")).over(earlier), F.lit(0))
    )
    return rows.select(
        "conv_id", "perspective", F.col("position").cast("long").alias("position"), "turn", "speaker", "rendered",
        F.col("start").cast("long").alias("start"), F.length("rendered").cast("long").alias("length"),
        F.when(trained, F.col("start") + F.length("head")).cast("long").alias("mask_start"),
        F.when(trained, F.col("start") + F.length("rendered") - 1).cast("long").alias("mask_end"),
    )


#: The same in DuckDB's SQL, over the view conversations.
ORACLE_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS position FROM said
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), headed AS (
  SELECT p.conv_id, perspective, position, turn, speaker, text,
         CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
), rendered AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM headed
), summed AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY position
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rendered
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, rendered, start,
       CAST(length(rendered) AS BIGINT) AS length,
       CASE WHEN speaker = perspective THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN speaker = perspective THEN CAST(start + length(rendered) - 1 AS BIGINT) END AS mask_end
FROM summed
"""
