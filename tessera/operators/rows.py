"""Row algebra over an explicit row number ``_idx`` (0-based, dense).

Spark rows have no order of their own, so each operator that is about order
takes or gives ``_idx``.  Random choices are md5 orders of a seed and a key:
exact in size, repeatable, and alike on any engine.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDX = "_idx"

#: Keys that are looked at for each range of ``ranged``.
EDGE_SAMPLE = 50


def ranged(df: DataFrame, *order: str | Column, name: str = "__part") -> DataFrame:
    """A column with the number of the key range each row is in; ranges ascend with the keys.

    The edges come from a sample of about ``EDGE_SAMPLE`` keys a shuffle
    partition and are fixed before the plan is built, so every use of the column
    agrees, however the rows are shuffled, coalesced or computed again.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(key.alias("key"))
    n = keyed.count() if parts > 1 else 0
    if not n:
        return df.withColumn(name, F.lit(0))
    share = EDGE_SAMPLE * parts / n
    few = (keyed if share >= 1 else keyed.sample(share, seed=1)).agg(F.sort_array(F.collect_list("key")).alias("s"))
    marks = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / parts).cast("int")))
    edges = few.select(F.array_distinct(F.filter(marks, lambda x: x.isNotNull())).alias("__edges"))
    one = spark.createDataFrame(edges.collect(), edges.schema)
    start = F.struct(F.lit(0).alias("low"), F.size("__edges").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.get("__edges", middle) <= key
        step = F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))
        return F.when(s["low"] < s["high"], step).otherwise(s)

    turns = F.sequence(F.lit(0), F.lit(parts.bit_length()))
    found = F.aggregate(turns, start, halve, lambda s: s["low"])
    return df.crossJoin(F.broadcast(one)).withColumn(name, found).drop("__edges")  # one row


def numbered(df: DataFrame, *order: str | Column, name: str = IDX) -> DataFrame:
    """Dense row numbers in the given ascending order, without gathering rows in one task.

    Rows are numbered within key ranges; the offsets of the ranges come from one
    count for each of them.  The order should be total, as rows of equal keys
    share a range and may swap numbers.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = ranged(df, *keys)
    ranked = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each range.
    offsets = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = ranked.join(F.broadcast(offsets), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__part", "__rank", "__before")


def shuffled_key(key: str | Column, seed: int) -> Column:
    """A key whose order is a seeded permutation."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))


def _shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return numbered(df.withColumn("__md5", shuffled_key(key, seed)), "__md5", key, name="_rank").drop("__md5")


def sample(df: DataFrame, n: int, key: str = IDX, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) without replacement."""
    return df.orderBy(shuffled_key(key, seed), key).limit(n)


def train_test_split(df: DataFrame, test_size: float = 0.2, key: str = IDX, seed: int = 42) -> DataFrame:
    """A ``split`` column: ``test`` for the first ceil(test_size * n) rows in shuffled order, else ``train``."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    total = df.count()
    out = _shuffled(df, key, seed)
    return out.withColumn("split", F.when(F.col("_rank") < math.ceil(test_size * total), "test").otherwise("train")).drop("_rank")


def ordered_percent_split(df: DataFrame, percent: float, key: str = IDX) -> DataFrame:
    """A ``split`` column: the last ``percent`` of the rows in order are ``eval``."""
    gap = int((1 - percent / 100) * df.count())
    return numbered(df, key, name="_rank").withColumn("split", F.when(F.col("_rank") < gap, "train").otherwise("eval")).drop("_rank")


def strided_shards(df: DataFrame, k: int, key: str = IDX, seed: int = 42) -> DataFrame:
    """A ``shard`` column: shuffled rows dealt out in turn."""
    return _shuffled(df, key, seed).withColumn("shard", (F.col("_rank") % k).cast("int")).drop("_rank")


def next_epoch_seed(seed: int) -> int:
    return seed * 37 % 1000000009


def take(df: DataFrame, n: int | None, key: str = IDX) -> DataFrame:
    """The first ``n`` rows in order; all for None."""
    return df if n is None else df.orderBy(key).limit(n)


def batch_sizes(batch: int, world: int, alpha: float, local: bool = False) -> tuple[int, int]:
    """Prompts an iteration, and candidates for each."""
    return (int(batch / world), int(1 / alpha)) if local else (int(batch / world / alpha), 1)


def iteration_slice(df: DataFrame, iteration: int, size: int, key: str = IDX, seed: int = 42) -> DataFrame:
    """Rows ``iteration * size`` and on of a permutation; empty when they are used up."""
    return _shuffled(df, key, seed).where(F.col("_rank").between(iteration * size, (iteration + 1) * size - 1)).drop("_rank")


def _bounds(start: int | None, stop: int | None, step: int | None, n: int) -> range:
    return range(*slice(start, stop, step).indices(n))


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Rows by a Python-like slice of ``_idx``; ``_idx`` becomes the position in the result."""
    n = df.count() if any(x is None or x < 0 for x in (start, stop)) or (step or 1) < 0 else max(start, stop)
    wanted = _bounds(start, stop, step, n)
    if not len(wanted):
        return df.limit(0)
    low, high = min(wanted[0], wanted[-1]), max(wanted[0], wanted[-1])
    offset = (F.col(IDX) - wanted.start) / wanted.step
    return df.where(F.col(IDX).between(low, high) & ((F.col(IDX) - wanted.start) % abs(wanted.step) == 0)).withColumn(IDX, offset.cast("long"))


def select_indices(df: DataFrame, indices: Sequence[int] | Sequence[bool] | DataFrame) -> DataFrame:
    """Rows at the given positions, in that order and as often as given; or by a mask."""
    spark = df.sparkSession
    if not isinstance(indices, DataFrame):
        values = list(indices)
        if values and all(isinstance(v, bool) for v in values):
            values = [i for i, v in enumerate(values) if v]
        indices = spark.createDataFrame([(p, int(i)) for p, i in enumerate(values)], "position long, wanted long")
    joined = indices.join(df, indices["wanted"] == df[IDX])
    return joined.withColumn(IDX, F.col("position")).drop("position", "wanted")


def drop_indices(df: DataFrame, indices: Sequence[int] | DataFrame) -> DataFrame:
    """All rows but those at the given positions."""
    if not isinstance(indices, DataFrame):
        indices = df.sparkSession.createDataFrame([(int(i),) for i in indices], "wanted long")
    return df.join(indices, df[IDX] == indices["wanted"], "left_anti")


def chunk(df: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """A ``chunk`` column: ``k`` parts as even as can be, the larger ones first.

    An empty table has ``k`` empty parts; more parts than rows is an error.
    """
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("the number of chunks must be an int")
    if k <= 0:
        raise ValueError("the number of chunks must be positive")
    n = df.count() if n is None else n
    if n and k > n:
        raise ValueError(f"{n} rows can't fill {k} chunks")
    small, more = (n // k, n % k) if n else (1, 0)
    edge = more * (small + 1)
    at = F.when(F.col(IDX) < edge, F.floor(F.col(IDX) / (small + 1))).otherwise(more + F.floor((F.col(IDX) - edge) / small))
    return df.withColumn("chunk", at.cast("int"))


def split_size(df: DataFrame, size: int) -> DataFrame:
    """A ``batch`` column: pieces of ``size`` rows, the last one short."""
    if size <= 0:
        raise ValueError("size must be positive")
    return df.withColumn("batch", F.floor(F.col(IDX) / size).cast("long"))


def full_batches(df: DataFrame, size: int) -> DataFrame:
    """Pieces of ``size`` rows; a short last one is left out."""
    whole = df.count() // size * size
    return split_size(df.where(F.col(IDX) < whole), size)


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, short: bool = False) -> DataFrame:
    """Columns ``epoch`` and ``batch``; the rows must fill whole batches, but with ``short`` the last one of each epoch may be short."""
    if size <= 0:
        raise ValueError("size must be positive")
    n = df.count()
    if n % size and not short:
        raise ValueError(f"{n} rows don't fill batches of {size}")
    every = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return every.withColumn("batch", F.floor(F.col(IDX) / size).cast("long"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(IDX).cast("string")).cast("binary"))
    ranked = numbered(every.withColumn("__md5", key), "epoch", "__md5", IDX, name="_rank")
    return ranked.withColumn("batch", F.floor(F.col("_rank") % n / size).cast("long")).drop("__md5", "_rank")


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """``times`` copies of every row: aabb, or abab when not interleaved."""
    n = 0 if interleave else df.count()
    copies = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("__r", F.lit(0)).limit(0)
    place = F.col(IDX) * times + F.col("__r") if interleave else F.col("__r") * n + F.col(IDX)
    return copies.withColumn(IDX, place.cast("long")).drop("__r")


def repeat_each(df: DataFrame, counts: Column) -> DataFrame:
    """As many copies of each row as ``counts`` says; none for 0. ``_copy`` numbers them."""
    n = F.greatest(counts.cast("int"), F.lit(0))
    return df.withColumn("_copy", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))))


def pad_rows(df: DataFrame, k: int, first: bool = False) -> DataFrame:
    """``k`` more copies of the first or last row, at the end."""
    if k == 0:
        return df
    n = df.count()
    edge = df.where(F.col(IDX) == (0 if first else n - 1))
    more = edge.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(IDX, (F.col("__r") + n).cast("long")).drop("__r")
    return df.unionByName(more)


def reorder(df: DataFrame, permutation: Sequence[int] | DataFrame) -> DataFrame:
    return select_indices(df, permutation)


def unfold(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Array columns cut into ``n`` pieces, one row each; other columns repeat."""
    rows = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cut = {c: F.slice(F.col(c), (F.col("__r") * (F.size(c) / n) + 1).cast("int"), (F.size(c) / n).cast("int")) for c in columns}
    return rows.withColumns(cut).withColumn(IDX, (F.col(IDX) * n + F.col("__r")).cast("long")).drop("__r")


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables one after the other; ``_idx`` goes on."""
    out, n = first, first.count() if others else 0
    for df in others:
        out, n = out.unionByName(df.withColumn(IDX, F.col(IDX) + n)), n + df.count()
    return out


def merge_meta(metas: Sequence[Mapping]) -> dict:
    """Metadata of concatenated tables: ``metrics`` lists join, other values must agree."""
    out: dict = {}
    for meta in metas:
        for k, v in meta.items():
            if k == "metrics":
                out[k] = [*out.get(k, []), *(v if isinstance(v, list) else [v])]
            elif k in out and out[k] != v:
                raise ValueError(f"metadata {k} differs: {out[k]!r} and {v!r}")
            else:
                out[k] = v
    return out


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both by ``_idx``; shared ones must be equal, nulls and NaN included."""
    shared = [c for c in right.columns if c in left.columns and c != IDX]
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    out = left.join(renamed, IDX)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(left.dtypes)[c]))).drop(f"__{c}")
    return out


def pop(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table without the columns, and the columns (with ``_idx``)."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such columns: {', '.join(missing)}")
    return df.drop(*columns), df.select(IDX, *columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def rows_equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows (nulls and NaN equal themselves)."""
    if left.schema != right.schema and T.StructType(left.schema).simpleString() != right.schema.simpleString():
        return False
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
