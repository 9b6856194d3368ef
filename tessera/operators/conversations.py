"""Tables of turns to conversations and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``system`` (a leading system turn, else null) and the other messages in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    rows = df.groupBy(conv).agg(listed.alias("m"))
    leads = F.get("m", F.lit(0))["role"] == "system"
    message = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))
    body = F.when(leads, F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))).otherwise(F.col("m"))
    return rows.select(conv, F.when(leads, F.get("m", F.lit(0))["content"]).alias("system"), F.transform(body, message).alias("messages"))


def neighbours(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User turns with the assistant turn right after them, as input and output."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = df.select(conv, turn, "role", F.col("text").alias("input"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("output"))
    return rows.where("role = 'user' and next_role = 'assistant'").select(conv, turn, "input", "output")


def with_context(df: DataFrame, conv: str = "conv_id", turn: str = "turn", separator: str = "\n") -> DataFrame:
    """Each turn with the text of all turns before it."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("context", F.array_join(F.collect_list("text").over(w), separator))
