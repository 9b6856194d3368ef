"""From candidates and scores to preference pairs and best-of selections.

Candidate lists are arrays of (score, text) structs on their row, so selection
is by array functions on the row and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.losses import length_penalised
from tessera.functions.text import DISCARDED
from tessera.operators.rows import numbered

METHODS = ("random", "max_min", "max_max", "max_random")


def attach_scores(texts: Column, scores: Column) -> Column:
    """Candidates as (score, text) structs, by position."""
    pairs = F.arrays_zip(scores.alias("score"), texts.alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["score"].alias("score"), p["text"].alias("text")))


def regroup(df: DataFrame, n: int, text: str, prompt: str, idx: str = "_idx") -> DataFrame:
    """Blocks of ``n`` consecutive rows as one row: the prompt and its candidates in order."""
    if df.count() % n:
        raise ValueError(f"rows can't be grouped by {n}")
    grouped = df.groupBy(F.floor(F.col(idx) / n).alias(idx)).agg(
        F.min_by(prompt, idx).alias("input"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(text).alias("t")))), lambda x: x["t"]).alias("output")
    )
    return grouped.select(idx, "input", "output")


def flatten(df: DataFrame, lists: str, idx: str = "_idx") -> DataFrame:
    """One row for each element, with its position."""
    return df.select(idx, F.posexplode(lists).alias("pos", "value"))


def unflatten(df: DataFrame, idx: str = "_idx") -> DataFrame:
    """The lists again, each in the order of positions."""
    return df.groupBy(idx).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def _first_best(scores: Column, low: bool = False) -> Column:
    value = F.array_min(scores) if low else F.array_max(scores)
    return (F.array_position(scores, value) - 1).cast("int")


def _hash_order(n: Column, key: Column, seed: int) -> Column:
    """Positions 0 to n-1 in a seeded order of their own for each key."""
    positions = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    ranked = F.transform(positions, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(ranked), lambda x: x["i"])


def pair_indices(scores: Column, method: str, fast: bool = False, key: Column | None = None, seed: int = 42) -> Column:
    """(chosen, rejected) positions; null for lists of fewer than two.

    The first of equal scores is best and worst; for the two best, the later of
    equal scores comes first.  The pair is swapped unless its first score is
    strictly greater.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    key = F.lit(0) if key is None else key
    best = _first_best(scores)
    if method == "max_min":
        a, b = best, _first_best(scores, low=True)
    elif method == "max_max":
        order = F.array_sort(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
        a, b = F.get(order, F.size(order) - 1)["i"], F.get(order, F.size(order) - 2)["i"]
    elif fast:
        a, b = (F.lit(0), F.lit(1)) if method == "random" else (best, F.when(best != 0, 0).otherwise(1))
    else:
        order = _hash_order(F.size(scores), key, seed)
        if method == "random":
            a, b = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        else:
            a, b = best, F.get(F.filter(order, lambda i: i != best), F.lit(0))
    ahead = F.get(scores, a) > F.get(scores, b)
    pair = F.struct(F.when(ahead, a).otherwise(b).cast("int").alias("chosen"), F.when(ahead, b).otherwise(a).cast("int").alias("rejected"))
    return F.when(F.size(scores) >= 2, pair)


def to_pairs(df: DataFrame, method: str = "max_random", penalty: float = 0.0, margin_scale: float = 1.0, fast: bool = False, prompt: str = "input", candidates: str = "output", key: str = "_idx", seed: int = 42) -> DataFrame:
    """Prompt, chosen, rejected and margin of each row with two candidates or more.

    Penalised scores choose; the margin is of the raw scores.
    """
    scores = F.transform(candidates, lambda c: length_penalised(c["score"], c["text"], penalty))
    # A struct of the indices keeps the list's sort from being repeated in each use.
    picked = df.withColumn("__pair", pair_indices(scores, method, fast, F.col(key), seed)).where("__pair is not null")
    at = lambda side: F.get(candidates, F.col(f"__pair.{side}"))
    margin = (at("chosen")["score"] - at("rejected")["score"]) * margin_scale
    return picked.select(key, F.col(prompt).alias("prompt"), at("chosen")["text"].alias("chosen"), at("rejected")["text"].alias("rejected"), margin.alias("margin"))


def best_of(df: DataFrame, group: str, reward: str, order: str) -> DataFrame:
    """The row with the highest reward of each group (ties: the first), unless it is a discarded one.

    ``max_by`` aggregates before the shuffle, so a large group costs one row a task.
    """
    fields = [c for c in df.columns if c != group]
    top = df.groupBy(group).agg(F.max_by(F.struct(*fields), F.struct(F.col(reward), -F.col(order))).alias("__b"))
    return top.select(group, "__b.*").where(F.col(reward) != DISCARDED)


def top_share(df: DataFrame, alpha: float, reward: str, order: str) -> DataFrame:
    """The first ``int(n * alpha)`` rows by reward (ties: in order; null rewards last).

    Rows are cut by rank, as the share grows with the table.
    """
    worth = F.col(reward).cast("double")
    rank = numbered(df, worth.isNull(), -F.nanvl(worth, F.lit(float("inf"))), order, name="__rank")
    return rank.where(F.col("__rank") < int(df.count() * alpha)).drop("__rank")


def best_then_top(df: DataFrame, group: str, reward: str, order: str, k: int) -> DataFrame:
    """The best row of each group, and of those the ``k`` best."""
    return best_of(df, group, reward, order).orderBy(F.desc(reward), order).limit(k)


def valid_candidates(df: DataFrame, width: int | None = None, prompt: str = "input", candidates: str = "output") -> DataFrame:
    """Rows with a prompt, the expected number of candidates and a non-empty one."""
    good = (F.length(prompt) > 0) & F.exists(candidates, lambda x: F.length(x) > 0)
    if width is not None:
        good = good & (F.size(candidates) == width)
    return df.where(F.coalesce(good, F.lit(False)))


def mean_rewards(df: DataFrame, selected: Column, reward: str = "reward") -> DataFrame:
    """One row: the mean reward of all rows and of the selected ones."""
    return df.agg(F.avg(reward).alias("mean_reward"), F.avg(F.when(selected, F.col(reward))).alias("mean_selected"))
