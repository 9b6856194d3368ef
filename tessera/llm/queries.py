"""One query for each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import anchors, bpe, langid, minhash, mixing, rules, shards, suffix, templates, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, vocabulary, decoded="decoded", keep_caches=True))


@_query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op4_anchors")
def op4_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.drop_repeats(_table(spark, sf_dir, "documents"))


@_query("op9_langid")
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(*langid.training_rows(docs, ~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query("op7_rules")
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = rules.labelled_sample(docs, _table(spark, sf_dir, "labels"))
    return rules.judge(docs, rules.learn(sample))


@_query("op6_templates", templates.SQL)
def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_templates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query("op8_shards", shards.SQL)
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"))


@_query("op1_mixing", mixing.sql())
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("topic", mixing.topic(F.col("text")))
    out = mixing.mix(docs, mixing.TARGETS)
    return out.select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled", "copies")


@_query("op3_topk", topk.SQL)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@_query("op5_suffix")
def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(_table(spark, sf_dir, "documents"))
