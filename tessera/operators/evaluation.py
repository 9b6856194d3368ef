"""Evaluation: strided windows, likelihoods, accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import IGNORED, count_where


def eval_windows(df: DataFrame, length: str | Column, stride: int, max_length: int) -> DataFrame:
    """One row for each window over a sequence of ``length`` tokens: begin, end and the first scored position.

    A window scores only what the one before has not; the last one ends with the
    sequence.
    """
    if max_length < stride or stride <= 0:
        raise ValueError("stride must be positive and at most max_length")
    n = F.col(length) if isinstance(length, str) else length
    rows = df.withColumn("__n", n).where("__n > 0")
    rows = rows.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 1, F.lit(stride).cast("long"))))
    end = F.least(F.col("begin") + max_length, F.col("__n")).cast("long")
    scored = F.when(F.col("begin") == 0, 0).otherwise(F.least(F.col("begin") - stride + max_length, F.col("__n"))).cast("long")
    return rows.withColumns({"end": end, "scored_from": scored}).where("scored_from < __n").drop("__n")


def window_nll(logprobs: Column, begin: Column, end: Column, scored_from: Column, shift: bool = True) -> Column:
    """Mean negative log-likelihood of the scored tokens of a window (the window's first token has no context)."""
    first = F.greatest(scored_from, begin + 1) if shift else scored_from
    part = F.slice(logprobs, (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))
    return -F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(part), F.lit(0))


#: Most distinct tokens, and largest token, of a table that is sent to every task.
TABLE_TOKENS, TABLE_IDS = 100_000, 1 << 21


def unigram_logprobs(df: DataFrame, ids: str, idx: str) -> DataFrame:
    """Add each token's log share of all tokens: a stand-in scorer (null for a row without tokens).

    Tokens are counted before any shuffle.  A vocabulary within ``TABLE_TOKENS``
    and ``TABLE_IDS`` goes to every task as one array and lists are scored in
    place; a larger one is joined.
    """
    flat = df.select(idx, F.posexplode(ids).alias("pos", "token"))
    counts = df.select(F.explode(ids).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    few = counts.where("token is not null").limit(TABLE_TOKENS + 1).collect()
    if few and len(few) <= TABLE_TOKENS and 0 <= min(r["token"] for r in few) and max(r["token"] for r in few) < TABLE_IDS:
        table, total = [0] * (max(r["token"] for r in few) + 1), sum(r["c"] for r in few)
        for r in few:
            table[r["token"]] = r["c"]
        one = df.sparkSession.createDataFrame([(table,)], "__counts array<long>")
        scored = F.transform(ids, lambda t: F.ln(F.get("__counts", t) / F.lit(total)))
        return df.crossJoin(F.broadcast(one)).withColumn("logprobs", F.when(F.size(ids) > 0, scored)).drop("__counts")  # one row
    total = counts.agg(F.sum("c").alias("t"))
    logs = counts.crossJoin(F.broadcast(total)).select("token", F.ln(F.col("c") / F.col("t")).alias("lp"))
    scored = flat.join(logs, "token").groupBy(idx).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lp"))), lambda x: x["lp"]).alias("logprobs"))
    return df.join(scored, idx, "left")


def accuracy(match: Column) -> Column:
    return F.avg(match.cast("int").cast("double"))


def running_accuracy(df: DataFrame, batch: str, match: Column) -> DataFrame:
    """Correct and processed rows up to each batch."""
    per = df.groupBy(batch).agg(F.sum(match.cast("int")).alias("c"), F.count("*").alias("n"))
    up_to = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)  # one row for each batch
    return per.select(batch, F.sum("c").over(up_to).cast("long").alias("correct"), F.sum("n").over(up_to).cast("long").alias("processed"))


def token_accuracy(predicted: Column, labels: Column) -> Column:
    """Share of learned positions that the prediction before them got right."""
    pairs = F.arrays_zip(F.slice(predicted, F.lit(1), F.size(predicted) - 1).alias("p"), F.slice(labels, F.lit(2), F.size(labels) - 1).alias("l"))
    used = F.filter(pairs, lambda x: x["l"] != IGNORED)
    return F.size(F.filter(used, lambda x: x["p"] == x["l"])) / F.nullif(F.size(used), F.lit(0))


def dataset_statistics(df: DataFrame, ids: Column, labels: Column, pad_id: int = 0) -> DataFrame:
    """Rows, tokens, learned tokens and their means, in one row."""
    if df.isStreaming:
        raise ValueError("a stream has no statistics")
    tokens, targets = count_where(ids, lambda x: x != pad_id).cast("long"), count_where(labels, lambda x: x != IGNORED).cast("long")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(tokens).alias("total_tokens"),
        F.sum(targets).alias("target_tokens"),
        F.round(F.avg(tokens), 6).alias("avg_tokens"),
        F.round(F.avg(targets), 6).alias("avg_targets"),
    )
