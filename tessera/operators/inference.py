"""Model slots: generators and scorers are functions from columns to a column.

Deterministic built-in ones stand in for models; ``batched`` wraps any Python
callable over batches, and ``with_model`` loads a model once for a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.rows import IDX, repeat

Generator = Callable[[Column, Column], Column]
Scorer = Callable[[Column], Column]


def echo_generator(prompt: Column, rollout: Column) -> Column:
    """A stand-in for a model: a piece of the prompt that depends on the rollout."""
    start = F.length(prompt) * rollout / 8
    return F.concat(F.substring(prompt, start.cast("int") + 1, F.lit(40)), F.lit("###Human: "))


def length_scorer(text: Column) -> Column:
    """A stand-in reward: the share of distinct characters."""
    return F.round(F.size(F.array_distinct(F.split(text, ""))) / F.greatest(F.length(text), F.lit(1)), 6)


def batched(f: Callable[[pd.Series], pd.Series], kind: str = "double") -> Scorer:
    """A column function from a Python callable over Arrow batches."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return f(texts)

    return lambda column: run(column)


def with_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """Rows through a model that each partition loads once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def rollouts(prompts: DataFrame, n: int, generate: Generator = echo_generator, prompt: str = "input") -> DataFrame:
    """``n`` generations of every prompt, one row each, the copies of a prompt next to each other."""
    copies = repeat(prompts.select(IDX, prompt), n)
    return copies.withColumn("output", generate(F.col(prompt), (F.col(IDX) % n).cast("int")))


def score_candidates(df: DataFrame, score: Scorer = length_scorer, prompt: str = "input", candidates: str = "output") -> DataFrame:
    """Candidates as (score, text); the scorer sees prompt and candidate as one text.

    Each text is a row while it is scored, so any scorer works and rows stay small.
    """
    flat = df.select(IDX, prompt, F.posexplode(candidates).alias("pos", "text"))
    scored = flat.withColumn("score", score(F.concat(F.col(prompt), F.col("text"))).cast("double"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "score", "text")))
    back = scored.groupBy(IDX).agg(F.first(prompt).alias(prompt), listed.alias("l"))
    return back.select(IDX, prompt, F.transform("l", lambda x: F.struct(x["score"].alias("score"), x["text"].alias("text"))).alias(candidates))
