"""Chat formatting: every participant's view of a dialogue, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Marks of the markup that stand in a text or name are broken up, so that no turn can be forged."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, narrator: str = "system") -> DataFrame:
    """For each conversation and participant, the dialogue with that participant as assistant.

    One row per turn and perspective: conv_id, perspective, turn, speaker,
    chat_role (assistant for the perspective's own turns, system for the
    narrator's, else user), speaker_name (of the named users, else null),
    rendered (the turn in chat markup), mask_start and mask_length (the code
    points of `rendered` that are trained on: text and end mark of own turns;
    length 0 elsewhere) and trained.

    The turns of a perspective in order of `turn` are its dialogue; they stay
    rows, so a conversation of any length is never gathered in one task. The
    narrator is no participant; a turn without a role is spoken by "unknown".
    Null text is empty; `<|` in a text or name is rendered as `< |`. Repeated turns stay, each rendered. A conversation with
    only narrator turns has no perspective and no row. Turns without conv_id
    have no row, as they are in no dialogue. Other columns are ignored.
    """
    t = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), plain(F.coalesce("text", F.lit(""))).alias("body")
    )
    seats = t.where(F.col("speaker") != narrator).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == narrator, "system").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|im_start|>"), role, F.coalesce(F.concat(F.lit(" name="), plain(name)), F.lit("")), F.lit("\n"))
    return t.join(seats, "conv_id").select(
        "conv_id", "perspective", "turn", "speaker", role.alias("chat_role"), name.alias("speaker_name"),
        F.concat(head, F.col("body"), F.lit("<|im_end|>\n")).alias("rendered"),
        F.when(own, F.char_length(head)).otherwise(0).cast("long").alias("mask_start"),
        F.when(own, F.char_length("body") + 10).otherwise(0).cast("long").alias("mask_length"),
        own.alias("trained"),
    )


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.*, s.perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM t JOIN s USING (conv_id)
), h AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS speaker_name,
         '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head
  FROM r
)
SELECT conv_id, perspective, turn, speaker, chat_role, speaker_name,
       head || body || '<|im_end|>' || chr(10) AS rendered,
       CAST(CASE WHEN chat_role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN chat_role = 'assistant' THEN length(body) + 10 ELSE 0 END AS BIGINT) AS mask_length,
       chat_role = 'assistant' AS trained
FROM h
"""
