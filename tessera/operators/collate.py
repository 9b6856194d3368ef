"""Batches: lists of rows that are trained together, filled to one length."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import IGNORED, head


def collate(df: DataFrame, batch: str, fills: Mapping[str, int], left: Collection[str] = (), limit: int | None = None) -> DataFrame:
    """Each list column of ``fills`` filled to the longest of its batch, at the end or, for those in ``left``, at the start.

    Columns have lengths of their own.  With ``limit``, lists are cut to it first.
    Rows are shuffled once, by batch.
    """
    whole = Window.partitionBy(batch)
    cut = lambda c: F.col(c) if limit is None else head(F.col(c), limit)
    out = df.withColumns({c: cut(c) for c in fills}).withColumns({f"__{c}": F.max(F.size(cut(c))).over(whole) for c in fills})

    def filled(c: str, fill: int) -> Column:
        pad = F.array_repeat(F.lit(fill), F.col(f"__{c}") - F.size(c))
        return F.concat(pad, F.col(c)) if c in left else F.concat(F.col(c), pad)

    return out.withColumns({c: filled(c, v) for c, v in fills.items()}).drop(*[f"__{c}" for c in fills])


def preference_batches(df: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """Prompt, chosen and rejected sequences: prompts are filled at the start, answers at the end."""
    kinds = {"_input_ids": pad_id, "_attention_mask": 0, "_labels": IGNORED}
    fills = {c: v for c in df.columns for end, v in kinds.items() if c.endswith(end)}
    return collate(df, batch, fills, left=[c for c in fills if c.startswith("prompt")])


def training_batches(df: DataFrame, batch: str, size: int, pad_id: int = 0) -> DataFrame:
    """Ids and labels filled to the longest of the batch, at most ``size``; the mask says what is no filling."""
    out = collate(df, batch, {"input_ids": pad_id, "labels": IGNORED}, limit=size)
    return out.withColumn("attention_mask", F.transform("input_ids", lambda x: (x != pad_id).cast("int")))
