"""Sample-stream rows: grouping of entries by key runs, metadata filters, choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rows import ranged


def consecutive_groups(df: DataFrame, key: str, order: str) -> DataFrame:
    """A ``group`` number (from 0) for each run of equal keys in order.

    Order is over the whole table, so rows are numbered within ranges first and
    only one row a range is put in sequence.
    """
    inside = Window.partitionBy("__part").orderBy(order)
    marked = ranged(df, order).withColumn("__prev", F.lag(key).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    new = F.when(F.col("__first"), 0).otherwise((~F.col("__prev").eqNullSafe(F.col(key))).cast("int"))
    counted = marked.withColumn("__runs", F.sum(new).over(inside))
    edges = counted.groupBy("__part").agg(F.min_by(key, order).alias("__a"), F.max_by(key, order).alias("__b"), F.max("__runs").alias("__n"))
    line = Window.orderBy("__part")
    joins = edges.withColumn("__new", (~F.lag("__b").over(line).eqNullSafe(F.col("__a"))).cast("int") * (F.row_number().over(line) > 1).cast("int"))
    before = F.sum(F.col("__n") + F.col("__new")).over(line) - F.col("__n")
    offsets = joins.select("__part", before.alias("__before"))
    out = counted.join(F.broadcast(offsets), "__part").withColumn("group", (F.col("__before") + F.col("__runs")).cast("long"))
    return out.drop("__part", "__prev", "__first", "__runs", "__before")


def split_at_repeats(entries: Column) -> Column:
    """An ordered list of (suffix, data) cut before each suffix that the current piece has already."""
    empty = F.slice(entries, F.lit(1), F.lit(0))
    start = F.struct(F.slice(F.array(entries), F.lit(1), F.lit(0)).alias("done"), empty.alias("open"))

    def step(s: Column, e: Column) -> Column:
        again = F.exists(s["open"], lambda x: F.lower(x["suffix"]) == F.lower(e["suffix"]))
        return F.struct(F.when(again, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(again, F.array(e)).otherwise(F.concat(s["open"], F.array(e))).alias("open"))

    return F.aggregate(entries, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def group_entries(df: DataFrame, prefix: str, suffix: str, data: str, order: str) -> DataFrame:
    """Samples of consecutive entries with one prefix; a repeated suffix starts a new one."""
    runs = consecutive_groups(df.select(prefix, F.lower(suffix).alias("suffix"), F.col(data).alias("data"), order), prefix, order)
    listed = runs.groupBy("group", prefix).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "suffix", "data"))).alias("e"))
    pieces = listed.select("group", prefix, F.posexplode(split_at_repeats(F.col("e"))).alias("piece", "e"))
    return pieces.select("group", "piece", F.col(prefix).alias("key"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["suffix"], x["data"]))).alias("sample"))


def metadata_passes(json: Column, min_size: float = 1024, max_mark: float = 0.5, width: str = "original_width", height: str = "original_height", mark: str = "pwatermark") -> Column:
    """Whether JSON metadata is large enough and likely without a mark; anything odd fails.

    A missing or zero mark probability counts as 1.
    """
    number = lambda name, default: F.coalesce(F.nullif(F.get_json_object(json, f"$.{name}").try_cast("double"), F.lit(0.0)), F.lit(default))
    return F.coalesce((number(width, 0.0) >= min_size) & (number(height, 0.0) >= min_size) & (number(mark, 1.0) <= max_mark), F.lit(False))


def keep_keys(sample: Column, keys: list[str]) -> Column:
    return F.map_filter(sample, lambda k, _: k.isin(keys))


def first_present(sample: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(sample, F.lit(k)) for k in keys])


def buffered_shuffle(df: DataFrame, size: int = 1000, seed: int = 42, idx: str = "_idx") -> DataFrame:
    """Rows in a seeded order within buffers of ``size`` consecutive ones."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")).cast("binary"))
    buffers = df.withColumn("__b", F.floor(F.col(idx) / size))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key, idx))
    return buffers.withColumn(idx, (F.col("__b") * size + place - 1).cast("long")).drop("__b")


def epoch_batches(n: int, global_batch: int, workers: int) -> int:
    return -(-n // (global_batch * workers))


def uniform(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def choose_caption(captions: Column, key: Column, drop: float = 0.0, train: bool = False, seed: int = 42) -> Column:
    """'' with probability ``drop``; else the first caption, or a seeded random one in training."""
    at = F.floor(uniform(key, seed + 1) * F.size(captions)).cast("int") if train else F.lit(0)
    return F.when(uniform(key, seed) < drop, F.lit("")).otherwise(F.get(captions, at))


def oriented(label_0: Column, first: Column, second: Column) -> Column:
    """The preferred of two first."""
    return F.when(label_0 == 0, F.array(second, first)).otherwise(F.array(first, second))
