"""Queries over batches, paired and tool conversations, sampling shares, image prompts and round reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import chat, images, sampling, tokens
from tessera.operators import collate, conversations, preference
from tessera.plans import pipelines
from tessera.plans.registry import query, table
from tessera.plans.row_queries import ORDER, _candidates
from tessera.plans.text_queries import SQL_CONV, digest
from tessera.sources import datasets

CHARS = "list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: ord(c))"
DIGEST = "md5(array_to_string({0}, ','))"


def _sql_turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


def _conversations(spark, d):
    return conversations.from_turns(table(spark, d, "conversations")).withColumnRenamed("conv_id", "_idx")


@query(
    "tool_tokens",
    f"""
WITH {SQL_CONV}, e AS (SELECT conv_id, sys, unnest(msgs[1:rounds * 2]) AS m, unnest(range(rounds * 2)) AS i FROM valid WHERE rounds > 0),
g AS (SELECT *, count(*) FILTER (WHERE m.role = 'assistant') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, grp) IN (2, 4) AS used, CASE WHEN trim(sys) <> '' THEN sys ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN 'search,time' ELSE '' END AS shown FROM g),
s AS (SELECT conv_id, i, m.role IN ('function', 'assistant') AS learned,
  {CHARS.format("CASE WHEN m.role = 'user' THEN " + _sql_turn("user", "m.content") + " WHEN m.role IN ('function', 'assistant') THEN " + _sql_turn("assistant", "m.content") + " WHEN m.role = 'observation' THEN " + _sql_turn("tool", "m.content") + " ELSE '' END")} AS ids FROM n WHERE used
  UNION ALL SELECT conv_id, -1, false, {CHARS.format(_sql_turn("system", "shown"))} FROM n WHERE used AND i = 0 AND shown <> ''),
t AS (SELECT conv_id, flatten(list(ids ORDER BY i)) AS ids, flatten(list(list_transform(ids, lambda x: CASE WHEN learned THEN x ELSE -100 END) ORDER BY i)) AS labels FROM s GROUP BY 1)
SELECT conv_id AS _idx, {DIGEST.format("ids")} AS ids, {DIGEST.format("labels")} AS labels FROM t""",
)
def tool_tokens(spark, d):
    shape = chat.preset("qwen2_for_tool")
    tools = F.when(F.col("_idx") % 2 == 0, F.array(F.lit("search"), F.lit("time")))
    row = chat.tool_tokenized(shape, chat.valid_messages(F.col("messages")), tokens.codepoints, 1, 2, system=F.col("system"), tools=tools)
    rows = _conversations(spark, d).select("_idx", row.alias("r")).where(F.size("r.input_ids") > 0)
    return rows.select("_idx", digest(F.col("r.input_ids")).alias("ids"), digest(F.col("r.labels")).alias("labels"))


@query(
    "paired_tokens",
    f"""
WITH {SQL_CONV}, r AS (SELECT conv_id, rounds, msgs, rounds > 0 AND conv_id % 5 <> 0 AS good FROM valid),
s AS (SELECT *, list_transform(msgs[1:rounds * 2], lambda m, i: CASE WHEN i % 2 = 1 THEN {_sql_turn("user", "m.content")} ELSE {_sql_turn("assistant", "m.content")} END) AS said FROM r)
SELECT conv_id AS _idx, NOT good AS is_corrupt, CASE WHEN good THEN {DIGEST.format(CHARS.format("array_to_string(said, '')"))} ELSE md5('') END AS chosen,
  CASE WHEN good THEN {DIGEST.format(CHARS.format("array_to_string(said[1:2], '')"))} ELSE md5('') END AS rejected FROM s""",
)
def paired_tokens(spark, d):
    side = lambda m: F.struct(m.alias("messages"))
    pairs = _conversations(spark, d).select("_idx", side(F.col("messages")).alias("chosen"), side(F.when(F.col("_idx") % 5 != 0, F.slice("messages", 1, 2))).alias("rejected"))
    rows = pipelines.paired_rows(datasets.TypedDataset(pairs, "paired_conversation"))
    return rows.select("_idx", "is_corrupt", digest(F.col("input_ids_chosen")).alias("chosen"), digest(F.col("input_ids_rejected")).alias("rejected"))


@query(
    "preference_batches",
    f"""
WITH c AS (SELECT l_orderkey, list(l_extendedprice ORDER BY {ORDER}) AS s, list(l_partkey || '-' || l_linenumber ORDER BY {ORDER}) AS t FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, 'order ' || l_orderkey AS q, t[list_position(s, list_max(s))] AS a, t[list_position(s, list_min(s))] AS b FROM c WHERE len(s) >= 2),
i AS (SELECT l_orderkey, l_orderkey // 8 AS batch, {CHARS.format("q")} AS q, {CHARS.format("q || a")} || [2] AS a, {CHARS.format("b")} || [2] AS b FROM p),
m AS (SELECT *, max(len(q)) OVER w AS nq, max(len(a)) OVER w AS na, max(len(q) + len(b)) OVER w AS nb FROM i WINDOW w AS (PARTITION BY batch))
SELECT l_orderkey AS _idx, {DIGEST.format("list_resize([]::INT[], nq - len(q), 0) || q")} AS prompt_ids, {DIGEST.format("list_resize(a, na, 0)")} AS chosen_ids,
  {DIGEST.format("list_resize(list_resize([]::INT[], len(q), -100) || b, nb, -100)")} AS rejected_labels FROM m""",
)
def preference_batches(spark, d):
    rows = pipelines.preference_training_batches(_candidates(spark, d), 8)
    return rows.select("_idx", *[digest(F.col(c)).alias(n) for c, n in (("prompt_input_ids", "prompt_ids"), ("chosen_input_ids", "chosen_ids"), ("rejected_labels", "rejected_labels"))])


@query(
    "training_batches",
    f"""
WITH t AS (SELECT item_id, item_id // 16 AS batch, {CHARS.format("text")}[1:128] AS ids FROM benchmark),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM t)
SELECT item_id AS _idx, {DIGEST.format("list_resize(ids, n, 0)")} AS ids, {DIGEST.format("list_resize(ids, n, -100)")} AS labels, len(ids)::INT AS used FROM m""",
)
def training_batches(spark, d):
    ids = tokens.codepoints(F.col("text"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("_idx"), F.floor(F.col("item_id") / 16).alias("batch"), ids.alias("input_ids"), ids.alias("labels"))
    made = collate.training_batches(rows, "batch", 128)
    return made.select("_idx", digest(F.col("input_ids")).alias("ids"), digest(F.col("labels")).alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"))


SQL_SHARES = """
v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS s, unnest(range(len(embedding))) AS i FROM embeddings),
x AS (SELECT vec_id, i, exp(s - max(s) OVER w) AS e, exp(s / 0.25 - max(s / 0.25) OVER w) AS f FROM v WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT vec_id, i, e / sum(e) OVER w AS p, f / sum(f) OVER w AS q FROM x WINDOW w AS (PARTITION BY vec_id))"""


@query(
    "nucleus_shares",
    f"""
WITH {SQL_SHARES}, c AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY q DESC, i ROWS UNBOUNDED PRECEDING) AS cum FROM p)
SELECT vec_id AS _idx, (count(*) FILTER (WHERE cum <= 0.9))::INT AS kept, round(max(q) / sum(q) FILTER (WHERE cum <= 0.9), 6) AS top, arg_max(i, (q, -i))::INT AS best FROM c GROUP BY 1""",
)
def nucleus_shares(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("_idx"), "embedding", sampling.probabilities(F.col("embedding"), 0.25, 0.9).alias("p"))
    best = F.array_position(sampling.probabilities(F.col("embedding")), F.lit(1.0)) - 1
    return rows.select("_idx", F.size(F.filter("p", lambda x: x > 0)).alias("kept"), F.round(F.array_max("p"), 6).alias("top"), best.cast("int").alias("best"))


@query(
    "speculative_round",
    f"""
WITH {SQL_SHARES}, u AS (SELECT *, (vec_id * 37 + i * 11) % 100 / 100.0 AS u FROM p),
n AS (SELECT vec_id, coalesce(min(i) FILTER (WHERE i < 4 AND u * q > p), 4) AS n, max(u) FILTER (WHERE i = 4) AS r FROM u GROUP BY 1),
l AS (SELECT u.vec_id, i, n, r, CASE WHEN n < 4 THEN greatest(p - q, 0) ELSE p END AS w FROM u JOIN n USING (vec_id)),
c AS (SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY vec_id) AS cum FROM l)
SELECT vec_id AS _idx, array_to_string(list_append(range(any_value(n)), min(i) FILTER (WHERE w > 0 AND cum > r)), ',') AS tokens FROM c GROUP BY 1""",
)
def speculative_round(spark, d):
    # Stand-in models that give the same shares at every place.
    made = table(spark, d, "embeddings").select(F.col("vec_id").alias("_idx"), sampling.probabilities(F.col("embedding"), 1.0).alias("p"), sampling.probabilities(F.col("embedding"), 0.25).alias("q"))
    uniforms = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("_idx") * 37 + i * 11) % 100 / 100.0)
    guesses = F.array(*[F.lit(i) for i in range(4)])
    found = sampling.speculate(guesses, F.array_repeat("p", 5), F.array_repeat("q", 4), uniforms)
    return made.select("_idx", F.array_join(found.cast("array<string>"), ",").alias("tokens"))


@query(
    "image_prompts",
    f"""
WITH {SQL_CONV}, s AS (SELECT conv_id, coalesce(sys, 'A chat.') AS sys, msgs FROM conv WHERE len(msgs) > 0)
SELECT conv_id AS _idx,
  sys || '###' || array_to_string(list_transform(msgs, lambda m, i: m.role || ': ' || CASE WHEN i = 1 THEN '<image>' || chr(10) || trim(m.content) ELSE m.content END || '###'), '') AS single,
  sys || ' ' || array_to_string(list_transform(msgs, lambda m, i: m.role || ': ' || m.content || CASE WHEN i % 2 = 1 THEN ' ' ELSE '</s>' END), '') AS two,
  sys || '|' || array_to_string(list_transform(msgs, lambda m: m.role || m.content || '|'), '') AS mpt,
  ltrim(array_to_string(list_transform(msgs, lambda m, i: CASE WHEN i % 2 = 1 THEN '<s>[INST] ' || CASE WHEN i = 1 THEN '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || m.content || ' [/INST]' ELSE ' ' || m.content || ' </s>' END), ''), '<s>') AS llama_2,
  sys || array_to_string(list_transform(msgs, lambda m, i: m.content || CASE WHEN i % 2 = 1 THEN chr(10) ELSE '' END), '') AS plain FROM s""",
)
def image_prompts(spark, d):
    rows = _conversations(spark, d).where(F.size("messages") > 0).withColumn("system", F.coalesce("system", F.lit("A chat.")))
    said, system = F.col("messages"), F.col("system")
    return rows.select(
        "_idx",
        images.prompt("single", images.image_first(said), system).alias("single"),
        images.prompt("two", said, system, " ", "</s>").alias("two"),
        images.prompt("mpt", said, system, "|").alias("mpt"),
        images.prompt("llama_2", said, system, "<s>", "</s>").alias("llama_2"),
        images.prompt("plain", said, system, "\n").alias("plain"),
    )


@query(
    "image_interleave",
    f"""
WITH t AS (SELECT item_id, {CHARS.format("text")} AS ids FROM benchmark)
SELECT item_id AS _idx, {DIGEST.format("ids[1:5] || [-200, -200] || ids[6:12] || [-300] || ids[13:]")} AS ids FROM t""",
)
def image_interleave(spark, d):
    blocks = F.array(F.array(F.lit(-200), F.lit(-200)), F.array(F.lit(-300)))
    made = images.interleave(tokens.codepoints(F.col("text")), F.array(F.lit(5), F.lit(7)), blocks)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("_idx"), digest(made).alias("ids"))


@query("mean_rewards", "SELECT round(avg(l_quantity::DOUBLE), 6) AS mean_reward, round(avg(l_quantity::DOUBLE) FILTER (WHERE l_linenumber = 1), 6) AS mean_selected FROM lineitem")
def mean_rewards(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("double").alias("reward"))
    means = preference.mean_rewards(rows, F.col("l_linenumber") == 1)
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])
