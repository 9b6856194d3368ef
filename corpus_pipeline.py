"""From raw documents to token digests, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``; other columns are left out.  An empty table gives
an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, minhash, mixing, templates
from tessera.llm.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Documents whose language is less sure than this are rejected, like those without any letter.
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; null texts and texts without a letter go, and all where no row has a language to learn from."""
    found = langid.identify(docs.select(*COLUMNS), ~langid.held_out())
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates go; so do documents of which nothing else is left. Null and empty texts stay as they are."""
    out = templates.drop_templates(docs.select(*COLUMNS))
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics; documents of scarce cells are repeated."""
    rows = docs.select(*COLUMNS).withColumn("topic", mixing.topic(F.col("text")))
    drawn = mixing.mix(rows, mixing.TARGETS).where("sampled")
    return drawn.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact token ids of every document that is left, decoded again, as digests."""
    vocabulary = bpe.read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: The first stage trains a network, which SQL can't express.  The operators behind the stages have brute-force tests (tests/llm);
#: the run as a whole is only compared with its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
