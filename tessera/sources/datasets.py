"""Typed datasets: JSON envelopes in, checks, and sinks out.

An envelope is a JSON object with ``type`` and ``instances``; a dataset folder
holds envelopes of one type.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import rows as R

_MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"
_CONVERSATION = f"conversation_id STRING, system STRING, tools ARRAY<STRING>, messages {_MESSAGES}"
_INNER = f"STRUCT<conversation_id: STRING, system: STRING, tools: ARRAY<STRING>, messages: {_MESSAGES}>"

# The dataset types, their required fields and their columns.
REQUIRED: dict[str, tuple[str, ...]] = {
    "text_only": ("text",),
    "text2text": ("input", "output"),
    "conversation": ("messages",),
    "paired_conversation": ("chosen", "rejected"),
    "paired_text_to_text": ("prompt", "chosen", "rejected"),
    "float_only": ("value",),
    "image_text": ("images", "text"),
    "text_to_textlist": ("input", "output"),
    "text_to_scored_textlist": ("input", "output"),
}
COLUMNS: dict[str, str] = {
    "text_only": "text STRING",
    "text2text": "input STRING, output STRING",
    "conversation": _CONVERSATION,
    "paired_conversation": f"chosen {_INNER}, rejected {_INNER}",
    "paired_text_to_text": "prompt STRING, chosen STRING, rejected STRING, margin DOUBLE",
    "float_only": "value DOUBLE",
    "image_text": "images ARRAY<STRING>, text STRING",
    "text_to_textlist": "input STRING, output ARRAY<STRING>",
    "text_to_scored_textlist": "input STRING, output ARRAY<STRUCT<score: DOUBLE, text: STRING>>",
}


def check_type(kind: str | None) -> str:
    if kind not in REQUIRED:
        raise ValueError(f"unknown dataset type {kind!r}; known: {', '.join(REQUIRED)}")
    return kind


def check_fields(kind: str, columns: Iterable[str]) -> None:
    if missing := set(REQUIRED[check_type(kind)]) - set(columns):
        raise ValueError(f"{kind} instances lack: {', '.join(sorted(missing))}")


@dataclass(frozen=True)
class TypedDataset:
    """A DataFrame with ``_idx``, its type and driver-side metadata. Operators return new ones."""

    df: DataFrame
    kind: str
    meta: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_fields(self.kind, self.df.columns)

    def __len__(self) -> int:
        return self.df.count()

    def of(self, df: DataFrame, kind: str | None = None) -> TypedDataset:
        return replace(self, df=df, kind=kind or self.kind)

    def map(self, f: Callable[[DataFrame], DataFrame], remove: Sequence[str] = (), kind: str | None = None) -> TypedDataset:
        return self.of(f(self.df).drop(*remove), kind)

    def sample(self, n: int, seed: int = 42) -> TypedDataset:
        return self.of(R.sample(self.df, n, seed=seed))

    def split(self, test_size: float = 0.2, seed: int = 42) -> tuple[TypedDataset, TypedDataset]:
        both = R.train_test_split(self.df, test_size, seed=seed)
        return tuple(self.of(both.where(F.col("split") == s).drop("split")) for s in ("train", "test"))

    def drop(self, indices: Sequence[int]) -> TypedDataset:
        return self.of(R.drop_indices(self.df, indices))

    def take(self, n: int | None) -> TypedDataset:
        return self.of(R.take(self.df, n))

    def fingerprint(self, *more: object) -> str:
        """A key for results that depend on the plan, the type and the given options."""
        plan = self.df._jdf.queryExecution().analyzed().canonicalized().toString()
        return hashlib.md5("\0".join([plan, self.kind, *map(repr, more)]).encode()).hexdigest()

    def to_list(self) -> list[dict]:
        """All rows on the driver; for small data."""
        fields = [c for c in self.df.columns if c != R.IDX]
        return [r.asDict(recursive=True) for r in self.df.orderBy(R.IDX).select(*fields).collect()]

    def to_dict(self) -> dict:
        return {"type": self.kind, "instances": self.to_list()}

    def save(self, path: str, one_file: bool = False) -> None:
        save_envelope(self, path, one_file)


def sniff(spark: SparkSession, path: str, head: int = 100) -> DataFrame:
    """For each file: its type by the first or last characters (null: not found), and whether it has instances there."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    edges = F.concat(F.substring("value", 1, head), F.lit("\n"), F.right("value", F.lit(head)))
    kind = F.nullif(F.regexp_extract(edges, r'"type": *"([^"]+)"', 1), F.lit(""))
    return files.select("file", kind.alias("type"), edges.contains('"instances"').alias("has_instances"))


def preview(spark: SparkSession, path: str, chars: int = 100) -> DataFrame:
    """First and last characters of each file; no tail where the head has it all."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    tail = F.when(F.length("value") <= 2 * chars, "").otherwise(F.right("value", F.lit(chars)))
    return files.select("file", F.substring("value", 1, chars).alias("head"), tail.alias("tail"))


def load(spark: SparkSession, path: str, kind: str | None = None) -> TypedDataset:
    """All envelopes of a folder (``*.json``, and the parts that ``save_envelope`` writes) or one file, numbered by file and position.

    Every file must have a type and instances, and all types must be the same.
    """
    where = path if path.endswith(".json") else f"{path.rstrip('/')}/{{*.json,part-*.txt}}"
    heads = spark.read.schema("type STRING, instances STRING").option("multiLine", True).json(where).select(F.input_file_name().alias("file"), "*")
    state = heads.agg(F.count_if(F.col("type").isNull()).alias("untyped"), F.count_if(F.col("instances").isNull()).alias("bare"), F.array_sort(F.collect_set("type")).alias("types")).first()
    if state["untyped"] or not state["types"]:
        raise ValueError("a file has no type")
    if len(state["types"]) > 1:
        raise ValueError(f"files have different types: {', '.join(state['types'])}")
    if state["bare"]:
        raise ValueError("a file has no instances")
    found = check_type(state["types"][0])
    if kind and kind != found:
        raise ValueError(f"expected {kind}, found {found}")
    schema = T.StructType([T.StructField("instances", T.ArrayType(T.StructType.fromDDL(COLUMNS[found])))])
    envelopes = spark.read.schema(schema).option("multiLine", True).json(where)
    rows = envelopes.select(F.input_file_name().alias("__file"), F.posexplode("instances").alias("__pos", "__row")).select("__file", "__pos", "__row.*")
    return TypedDataset(R.numbered(rows, "__file", "__pos").drop("__file", "__pos"), found)


def from_rows(spark: SparkSession, kind: str, instances: Sequence[dict]) -> TypedDataset:
    """A dataset from driver-side rows; every row needs the required fields, and absent optional ones are null."""
    check_type(kind)
    for row in instances:
        check_fields(kind, row)
    schema = T.StructType.fromDDL(COLUMNS[kind])
    more = sorted({k for row in instances for k in row} - set(schema.names))
    for name in more:
        schema = schema.add(name, T.StringType())
    schema = T.StructType([T.StructField(R.IDX, T.LongType()), *schema.fields])
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    full = [{R.IDX: i, **{c: as_text(row.get(c)) if c in more else row.get(c) for c in schema.names[1:]}} for i, row in enumerate(instances)]
    return TypedDataset(spark.createDataFrame(full, schema), kind)


def from_dict(spark: SparkSession, envelope: dict) -> TypedDataset:
    if not {"type", "instances"} <= set(envelope):
        raise ValueError("an envelope needs type and instances")
    return from_rows(spark, envelope["type"], envelope["instances"])


def save_envelope(data: TypedDataset, path: str, one_file: bool = False) -> None:
    """A folder of envelope files, one for each partition; with ``one_file`` a single envelope (small data)."""
    fields = [F.col(c) for c in data.df.columns if c != R.IDX]
    if one_file:
        listed = data.df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(R.IDX).alias("i"), F.struct(*fields).alias("x")))), lambda r: r["x"]).alias("instances"))
    else:
        listed = data.df.groupBy(F.floor(F.col(R.IDX) / 10_000).alias("__b")).agg(F.array_sort(F.collect_list(F.struct(F.col(R.IDX).alias("i"), F.struct(*fields).alias("x")))).alias("r"))
        listed = listed.select(F.transform("r", lambda r: r["x"]).alias("instances"))
    listed.select(F.to_json(F.struct(F.lit(data.kind).alias("type"), "instances")).alias("value")).write.mode("overwrite").text(path)


def save_table(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """Rows as Parquet, with metadata beside them: stage results and inference results."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def save_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line: predictions and logs."""
    df.write.mode("append").json(path)


def load_text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Inputs and outputs of a text2text dataset."""
    return load(spark, path, "text2text").df.select(R.IDX, "input", "output")


def load_question_pairs(spark: SparkSession, path: str, sanity: bool = False) -> DataFrame:
    """Prompt, chosen and rejected from question/response files (for a check: 1000 rows at most)."""
    raw = spark.read.schema("question STRING, response_j STRING, response_k STRING").option("multiLine", True).json(path)
    rows = raw.select(F.concat(F.lit("Question: "), "question", F.lit("\n\nAnswer: ")).alias("prompt"), F.col("response_j").alias("chosen"), F.col("response_k").alias("rejected"))
    return rows.limit(1000) if sanity else rows


def load_images(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Image records (a bare JSON list, or an envelope of type text-image) with the paths of their files."""
    raw = spark.read.option("multiLine", True).json(path)
    if "instances" in raw.columns:
        raw = raw.select(F.inline("instances"))
    return raw.withColumn("path", F.concat_ws("/", F.lit(folder.rstrip("/")), F.col("image")))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def save_round(data: TypedDataset, path: str, iteration: int) -> None:
    """The training rows of one iteration as envelopes."""
    save_envelope(data, f"{path.rstrip('/')}/train_set_{iteration}")


def append_rewards(means: DataFrame, path: str) -> None:
    """A line of text for each round's mean rewards, added to what the folder has."""
    line = F.format_string("mean reward: %s, mean reward in training set: %s", F.col("mean_reward").cast("string"), F.col("mean_selected").cast("string"))
    means.select(line.alias("value")).write.mode("append").text(path)


def save_metadata(df: DataFrame, path: str) -> None:
    """Plain columns as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def describe(df: DataFrame) -> dict[str, str]:
    """Columns and their types."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def check_not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the dataset is empty")
    return df
