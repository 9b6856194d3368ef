"""Row streams: lazy filters, bounded takes and memory by session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.tokens import has_target


def scratch(spark: SparkSession) -> str:
    """A fresh folder: in the shared one that the session names, or a temporary one in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("a cluster must name a folder that all machines share in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, glob: str | None = None, files_a_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files under ``path``; with ``glob``, of the files and folders of files there that it names."""
    where = f"{path}/{glob}" if glob else path
    schema = spark.read.parquet(where).schema
    if glob and not any(c in glob for c in "*?[]{}\\"):
        where = f"{where[:-1]}[{where[-1]}]"  # as a pattern, a stream may be of one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(where)


def learned_rows(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows with any learned position; lazy on streams and tables alike."""
    return df.where(has_target(F.col(labels)))


def filter_then_take(df: DataFrame, condition, n: int) -> DataFrame:
    """The first ``n`` rows that pass, in arrival order."""
    return df.where(condition).limit(n)


def session_memory(turns: DataFrame, session: str, text: str, max_chars: int = 2048) -> DataFrame:
    """After each batch, every touched session's last ``max_chars`` characters of all its turns.

    ``turns`` has a ``seq`` column of whole numbers that orders a session's
    turns (nulls last), in whichever batch they arrive.  State is the last turns
    of each session, ``max_chars`` characters in all, so a late turn takes its
    place.  Null texts count for nothing; a session with no other has a null
    memory.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        known = state.exists and state.get[0] is not None
        for rows in batches:
            said = zip(rows["seq"].tolist(), rows["said"].tolist())
            new = [(None if seq != seq or seq is None else int(seq), words) for seq, words in said if isinstance(words, str)]
            known = known or bool(new)
            merged = sorted([*kept, *new], key=lambda turn: (turn[0] is None, turn[0] or 0))
            kept, room = [], max_chars
            for seq, words in reversed(merged):
                if words and room > 0:
                    kept.append((seq, words[-room:]))
                    room -= len(words)
            kept.reverse()
        state.update(([s for s, _ in kept], [w for _, w in kept]) if known else (None, None))
        yield pd.DataFrame({"session": [key[0]], "memory": ["".join(w for _, w in kept) if known else None]})

    named = turns.select(F.col(session).cast("long").alias("session"), F.col("seq").cast("long").alias("seq"), F.col(text).alias("said"))
    kept = "seqs array<long>, texts array<string>"
    return named.groupBy("session").applyInPandasWithState(update, "session long, memory string", kept, "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what there is now, into a table in the shared folder; with ``keys``, the last row of each of them.

    Each batch is a part of the table; no rows go through the driver.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/rows/__batch=-1")

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/__batch={batch}")

    query = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{path}/log").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.LongType())])).parquet(f"{path}/rows")
    if not keys:
        return rows.drop("__batch")
    others = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in df.columns])
