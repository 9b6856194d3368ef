"""Packing token lists into fixed-size blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 1000


def pack(df: DataFrame, columns: Sequence[str], size: int, group: int = GROUP, idx: str = "_idx", keep_short: bool = False) -> DataFrame:
    """Blocks of ``size`` over the lists of ``group`` consecutive rows laid end to end.

    What is left at a group's end is dropped; with ``keep_short``, a group that
    does not fill one block keeps its only, short piece.  ``idx`` must be dense
    row numbers.
    """
    if size <= 0 or group <= 0:
        raise ValueError("size and group must be positive")
    rows = df.withColumns({"_group": F.floor(F.col(idx) / group), "_n": F.size(columns[0])})
    # Offsets, pieces and blocks all stay where a group's rows were sent: one shuffle.
    inside = Window.partitionBy("_group")
    placed = rows.withColumns({"_off": F.sum("_n").over(inside.orderBy(idx)) - F.col("_n"), "_tot": F.sum("_n").over(inside)}).where("_n > 0")
    last = F.floor((F.col("_off") + F.col("_n") - 1) / size)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("_off") / size), last)))
    whole = F.col("block") < F.floor(F.col("_tot") / size)
    cut = cut.where(whole | ((F.col("_tot") < size) & F.lit(keep_short)))
    begin = F.greatest(F.col("block") * size - F.col("_off"), F.lit(0))
    end = F.least((F.col("block") + 1) * size - F.col("_off"), F.col("_n"))
    parts = F.struct(F.col(idx).alias("i"), *[F.slice(c, (begin + 1).cast("int"), (end - begin).cast("int")).alias(c) for c in columns])
    blocks = cut.groupBy(F.col("_group").alias("group"), "block").agg(F.sort_array(F.collect_list(parts)).alias("p"))
    return blocks.select("group", "block", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in columns])


def resolve_block_size(block: int | None, model_max: int, cap: int = 1024, truncate_to_model_max: bool = True) -> int:
    """The block size to pack with: the model's, up to a cap, unless given; a larger one is clamped or kept."""
    if block is None:
        return min(model_max, cap)
    return min(block, model_max) if truncate_to_model_max else block
