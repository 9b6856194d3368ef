"""Queries that run whole pipelines, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.operators import conversations, inference, preference
from tessera.operators import rows as R
from tessera.plans import pipelines
from tessera.plans.registry import query, table
from tessera.plans.row_queries import SQL_CANDIDATES, _candidates
from tessera.plans.text_queries import SQL_CONV, digest
from tessera.sources import datasets
from tessera.streaming import streams


def _texts(spark: SparkSession, d: str) -> datasets.TypedDataset:
    return datasets.TypedDataset(table(spark, d, "documents").select(F.col("doc_id").alias("_idx"), "text"), "text_only")


@query("finetune_blocks", "SELECT doc_id AS _idx, md5(array_to_string(list_transform(string_split(rpad(substr(text, 1, 256), 256, chr(1)), ''), lambda c: ord(c)), ',')) AS ids FROM documents WHERE length(text) > 0")
def finetune_blocks(spark, d):
    return pipelines.finetune_rows(_texts(spark, d), block=256, pad_id=1).select("_idx", digest(F.col("input_ids")).alias("ids"))


@query("finetune_packed", "WITH g AS (SELECT doc_id // 1000 AS grp, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1) SELECT grp AS \"group\", (length(t) // 4096)::BIGINT AS blocks FROM g")
def finetune_packed(spark, d):
    packed = pipelines.finetune_rows(_texts(spark, d), block=4096, pack=True)
    return packed.groupBy("group").agg(F.count("*").alias("blocks"))


@query("reward_training_rows", f"WITH {SQL_CANDIDATES} SELECT count(*)::BIGINT * 2 AS n, sum(least(length('order ' || l_orderkey || t[hi]), 32) + least(length('order ' || l_orderkey || t[lo]), 32))::BIGINT AS used FROM best WHERE r[hi] > r[lo]")
def reward_training_rows(spark, d):
    pairs = preference.to_pairs(_candidates(spark, d), "max_min", 0.5).where("chosen <> rejected or margin <> 0")
    rows = pipelines.reward_training_rows(pairs, size=32)
    return rows.agg(F.count("*").alias("n"), F.sum(tokens.count_where(F.col("input_ids"), lambda x: x != 0)).cast("long").alias("used"))


@query("dpo_length_filter", f"WITH {SQL_CANDIDATES} SELECT l_orderkey AS _idx FROM best WHERE length('order ' || l_orderkey || t[hi]) <= 18 AND length('order ' || l_orderkey || t[lo]) <= 18")
def dpo_length_filter(spark, d):
    return pipelines.fits_characters(preference.to_pairs(_candidates(spark, d), "max_min", 0.5), 18).select("_idx")


@query(
    "inference_inputs",
    f"WITH {SQL_CONV} SELECT conv_id AS _idx, '<|im_start|>user' || chr(10) || msgs[1].content || '<|im_end|>' || chr(10) AS input FROM conv WHERE len(msgs) > 0 AND msgs[len(msgs)].role = 'user' AND length(msgs[1].content) > 0",
)
def inference_inputs(spark, d):
    df = conversations.from_turns(table(spark, d, "conversations")).withColumnRenamed("conv_id", "_idx").where(F.size("messages") > 0)
    return pipelines.inference_inputs(datasets.TypedDataset(df, "conversation"), template="chatml")


SQL_MADE = """
p AS (SELECT item_id, text, unnest(range(4)) AS k FROM benchmark WHERE length(text) <= 256 AND length(text) > 0),
m AS (SELECT item_id, k, text, regexp_replace(regexp_replace(list_filter(string_split(substr(text, floor(length(text) * k / 8)::INT + 1, 40) || '###Human: ', '###Human'), lambda x: x <> '')[1], '^[\\s]+|[\\s]+$', '', 'g'), '^#+|#+$', '', 'g') AS o FROM p),
s AS (SELECT *, CASE WHEN contains(o, '#') OR length(o) < 2 THEN -888888888.0::DOUBLE ELSE round(len(list_distinct(string_split(text || o, ''))) / length(text || o), 6) END AS reward FROM m)"""


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(F.length("text") > 0).select(F.col("item_id").alias("_idx"), F.col("text").alias("input"))


@query(
    "raft_best",
    f"WITH {SQL_MADE}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY reward DESC, k) AS n FROM s) SELECT item_id AS prompt, reward, text || o AS text FROM r WHERE n = 1 AND reward > -888888888.0",
)
def raft_best(spark, d):
    return pipelines.raft_selection(_prompts(spark, d), 4).select("prompt", "reward", "text")


@query("raft_top", f"WITH {SQL_MADE} SELECT item_id * 4 + k AS _idx, reward, text || o AS text FROM s ORDER BY reward DESC, item_id * 4 + k LIMIT (SELECT floor(count(*) * 0.25)::BIGINT FROM s)")
def raft_top(spark, d):
    return pipelines.raft_selection(_prompts(spark, d), 4, alpha=0.25).select("_idx", "reward", "text")


@query("evaluate_answers", "SELECT o_orderkey AS _idx, (o_orderkey % 10)::VARCHAR AS answer, o_orderkey % 10 = o_custkey % 10 AS correct FROM orders")
def evaluate_answers(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"), F.col("o_orderkey").cast("string").alias("input"), (F.col("o_custkey") % 10).cast("string").alias("output"))
    # A stand-in model that ends in the question's last digit.
    reply = lambda q, _: F.concat(F.lit("The answer is "), F.right(q, F.lit(1)), F.lit("."))
    return pipelines.evaluate(df, "math", reply, "Q{input}").select("_idx", "answer", "correct")


@query("score_candidates", f"WITH {SQL_CANDIDATES} SELECT l_orderkey AS _idx, len(t)::INT AS n, round(list_sum(list_transform(t, lambda x: length('order ' || l_orderkey || x))), 3)::DOUBLE AS total FROM c")
def score_candidates(spark, d):
    rows = _candidates(spark, d).select("_idx", "input", F.col("output.text").alias("output"))
    scored = pipelines.reward_infer(rows, lambda t: F.length(t).cast("double"))
    total = F.aggregate(F.col("output.score"), F.lit(0.0), lambda a, x: a + x)
    return scored.select("_idx", F.size("output").alias("n"), F.round(total, 3).alias("total"))


@query("batched_scorer", "SELECT doc_id AS _idx, length(text)::DOUBLE AS score FROM documents")
def batched_scorer(spark, d):
    score = inference.batched(lambda s: s.str.len().astype(float))
    return table(spark, d, "documents").select(F.col("doc_id").alias("_idx"), score(F.col("text")).alias("score"))


@query("multistage_shards", "WITH r AS (SELECT doc_id AS _idx, row_number() OVER (ORDER BY md5('851:' || doc_id), doc_id) - 1 AS k FROM documents) SELECT _idx, (k % 3)::INT AS shard FROM r")
def multistage_shards(spark, d):
    return pipelines.multistage(table(spark, d, "documents").select(F.col("doc_id").alias("_idx")), 3)


@query("retrieval_contexts")
def retrieval_contexts(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit("\n\n")).alias("text"))
    return pipelines.retrieval_prompts(chunks, chunks.where("id % 100 = 0").select("id", "embedding"))


@query("tool_rows", f"WITH {SQL_CONV} SELECT conv_id AS _idx FROM valid WHERE rounds > 0")
def tool_rows(spark, d):
    df = conversations.from_turns(table(spark, d, "conversations")).withColumnRenamed("conv_id", "_idx")
    rows = pipelines.tool_rows(datasets.TypedDataset(df, "conversation"), block=64)
    return rows.where(F.exists("attention_mask", lambda x: x == 1)).select("_idx")


@query("json_envelope_roundtrip", "SELECT item_id AS _idx, text FROM benchmark")
def json_envelope_roundtrip(spark, d):
    path = streams.scratch(spark)
    df = table(spark, d, "benchmark").select(F.col("item_id").alias("_idx"), "text")
    datasets.save_envelope(datasets.TypedDataset(df, "text_only"), path, one_file=True)
    file = spark.read.format("binaryFile").load(f"{path}/part-*").select("path").first()[0]
    envelope = spark.read.schema("type STRING, instances ARRAY<STRUCT<text: STRING>>").json(file)
    return envelope.select(F.posexplode("instances").alias("pos", "x")).select(F.col("pos").cast("long").alias("_idx"), "x.text")


@query("iterative_alignment")
def iterative_alignment(spark, d):
    df = table(spark, d, "benchmark").where(F.length("text") > 0).select(F.col("item_id").alias("_idx"), "text")
    parts = pipelines.iterative_alignment(datasets.TypedDataset(df, "text_only"), 2, 4, streams.scratch(spark))
    return parts[0].unionByName(parts[1])


@query("stream_learned_rows", "SELECT event_id AS _idx, value FROM events WHERE value > 20")
def stream_learned_rows(spark, d):
    events = streams.read(spark, d, "events.parquet")
    labels = F.array(F.lit(tokens.IGNORED), F.when(F.col("value") > 20, 1).otherwise(tokens.IGNORED))
    rows = streams.learned_rows(events.select(F.col("event_id").alias("_idx"), "value", labels.alias("labels"))).drop("labels")
    return streams.drain(rows, f"learned_{uuid.uuid4().hex}")


@query("stream_filter_take")
def stream_filter_take(spark, d):
    events = streams.read(spark, d, "events.parquet")
    return streams.drain(streams.filter_then_take(events.select("event_id", "value"), F.col("value") > 20, 7), f"take_{uuid.uuid4().hex}")


@query("session_memory", "SELECT conv_id AS session, right(string_agg(text, '' ORDER BY turn), 512) AS memory FROM conversations GROUP BY 1")
def session_memory(spark, d):
    turns = streams.read(spark, d, "conversations.parquet").withColumnRenamed("turn", "seq")
    return streams.drain(streams.session_memory(turns, "conv_id", "text", 512), f"memory_{uuid.uuid4().hex}", "update", ["session"])
