"""Sharding by extendible hashing, in DataFrame expressions only.

The directory is indexed by the leading bits of a hash of the key.  Starting
from one bucket, only buckets over the byte limit are split on another bit,
until every bucket fits.  The buckets of ``STEP`` levels are found from one
pre-aggregated histogram; only what is still too large goes on to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

BITS = 48
STEP = 12
LIMIT = 1 << 20


def key_bits(key: Column) -> Column:
    """The first 48 bits of the key's md5, as a number (null: like an empty key)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _level(sizes: DataFrame, done: int, limit: int) -> DataFrame:
    """For each bucket of ``done + STEP`` bits: depth, bytes and rows of the shard that it falls in (null: still too large)."""
    deep = done + STEP
    leaves = sizes.groupBy(F.shiftrightunsigned("h", BITS - deep).alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    nodes = leaves.select("leaf", "bytes", "rows", F.explode(F.sequence(F.lit(done), F.lit(deep))).alias("depth"))
    prefix = reduce(lambda c, d: c.when(F.col("depth") == d, F.shiftrightunsigned("leaf", deep - d)), range(done + 1, deep + 1), F.when(F.col("depth") == done, F.shiftrightunsigned("leaf", deep - done)))
    nodes = materialize(nodes.withColumn("prefix", prefix), "nodes")
    sums = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = nodes.join(sums, ["depth", "prefix"]).withColumn("ok", F.col("shard_bytes") <= limit)
    if deep >= BITS:  # no bits are left: what is still too large stays together
        fits = fits.withColumn("ok", F.col("ok") | (F.col("depth") == BITS))
    pick = F.min(F.when(F.col("ok"), F.struct("depth", "prefix", "shard_bytes", "shard_rows")))
    return fits.groupBy("leaf").agg(pick.alias("s")).select("leaf", "s.depth", "s.prefix", "s.shard_bytes", "s.shard_rows")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: the key as ``doc_id``, n_bytes, shard (its hash prefix in bits), depth, shard_bytes, shard_rows, fits.

    ``fits`` is false only for a shard that no further bit can split: one row, or
    rows of one key, over the limit.  A null text has no bytes.  Rows with equal
    keys (repeats, nulls) share a shard.  An empty table gives no rows.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), key_bits(F.col(key)).alias("h"))
    parts, open_rows = [], rows
    for done in range(0, BITS, STEP):
        deep = done + STEP
        level = materialize(_level(open_rows, done, limit), "directory")
        leaf = F.shiftrightunsigned("h", BITS - deep)
        # The first level has at most 2**STEP rows; deeper ones may be large and are joined by their size.
        side = F.broadcast(level) if done == 0 else level
        found = open_rows.withColumn("leaf", leaf).join(side, "leaf").drop("leaf")
        parts.append(found.where("depth is not null"))
        if level.where("depth is null").isEmpty():
            break
        open_rows = materialize(found.where("depth is null").select("doc_id", "n_bytes", "h"), "open")
    out = reduce(DataFrame.unionByName, parts)
    shard = F.expr(f"substring(lpad(bin(h), {BITS}, '0'), 1, depth)")
    return out.select("doc_id", "n_bytes", shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
       array_to_string(list_transform(string_split(substr(md5(doc_id::VARCHAR), 1, 6), ''), lambda c: substr(format('{{:04b}}', instr('0123456789abcdef', c) - 1), 1, 4)), '') AS h
     FROM documents),
n AS (SELECT doc_id, n_bytes, g AS depth, substr(h, 1, g::INT) AS shard FROM d, generate_series(0, 24) s(g)),
s AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM n GROUP BY 1, 2),
j AS (SELECT n.*, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY n.depth) AS k
      FROM n JOIN s USING (depth, shard) WHERE s.shard_bytes <= {LIMIT} OR n.depth = 24)
SELECT doc_id, n_bytes, shard, depth::INT AS depth, shard_bytes, shard_rows, shard_bytes <= {LIMIT} AS fits FROM j WHERE k = 1
"""
