"""Queries over row algebra, sampling, preference data, losses, metrics and sample streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import losses, tokens
from tessera.operators import evaluation, preference, retrieval, samples
from tessera.operators import rows as R
from tessera.plans.registry import query, table
from tessera.plans.text_queries import digest


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("_idx"), *more)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("_idx"), "user_id", "event_type", "value", "props")


SHUFFLED = "d AS (SELECT doc_id AS _idx, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)"


@query("sample_n", f"WITH {SHUFFLED} SELECT _idx FROM d WHERE rank < 50")
def sample_n(spark, d):
    return R.sample(_docs(spark, d), 50)


@query("train_test_split", f"WITH {SHUFFLED} SELECT _idx, CASE WHEN rank < ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM d")
def train_test_split(spark, d):
    return R.train_test_split(_docs(spark, d))


@query("ordered_percent_split", "SELECT doc_id AS _idx, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.95 * count(*) OVER ()) THEN 'train' ELSE 'eval' END AS split FROM documents")
def ordered_percent_split(spark, d):
    return R.ordered_percent_split(_docs(spark, d), 5)


@query("strided_shards", f"WITH {SHUFFLED} SELECT _idx, (rank % 4)::INT AS shard FROM d")
def strided_shards(spark, d):
    return R.strided_shards(_docs(spark, d), 4)


@query("iteration_slice", f"WITH {SHUFFLED} SELECT _idx FROM d WHERE rank >= 64 AND rank < 96")
def iteration_slice(spark, d):
    return R.iteration_slice(_docs(spark, d), 2, 32)


@query("limit_rows", "SELECT doc_id AS _idx FROM documents ORDER BY doc_id LIMIT 25")
def limit_rows(spark, d):
    return R.take(_docs(spark, d), 25)


@query("row_numbers", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS _idx FROM pages")
def row_numbers(spark, d):
    return R.numbered(table(spark, d, "pages").select("page_id", "url"), "url", "page_id").drop("url")


@query("chunk_ntile", "SELECT doc_id AS _idx, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS chunk FROM documents")
def chunk_ntile(spark, d):
    return R.chunk(_docs(spark, d), 7)


@query("split_size", "SELECT doc_id AS _idx, doc_id // 64 AS batch FROM documents")
def split_size(spark, d):
    return R.split_size(_docs(spark, d), 64)


@query("full_batches", "SELECT doc_id AS _idx, doc_id // 64 AS batch FROM documents WHERE doc_id < (SELECT count(*) // 64 * 64 FROM documents)")
def full_batches(spark, d):
    return R.full_batches(_docs(spark, d), 64)


@query("mini_batches", "SELECT doc_id AS _idx, e::INT AS epoch, doc_id // 50 AS batch FROM documents, range(2) t(e)")
def mini_batches(spark, d):
    return R.mini_batches(_docs(spark, d), 50, epochs=2, short=True)


@query("repeat_interleave", "SELECT doc_id * 3 + r AS _idx, n_chars FROM documents, range(3) t(r)")
def repeat_interleave(spark, d):
    return R.repeat(_docs(spark, d, "n_chars"), 3)


@query("repeat_tile", "SELECT doc_id + r * (SELECT count(*) FROM documents) AS _idx, n_chars FROM documents, range(3) t(r)")
def repeat_tile(spark, d):
    return R.repeat(_docs(spark, d, "n_chars"), 3, interleave=False)


@query("sample_level_repeat", "SELECT doc_id AS _idx, unnest(range(doc_id % 3))::INT AS _copy FROM documents")
def sample_level_repeat(spark, d):
    return R.repeat_each(_docs(spark, d), F.col("_idx") % 3)


@query("pad_rows", "SELECT doc_id AS _idx, n_chars FROM documents UNION ALL SELECT (SELECT count(*) FROM documents) + r, n_chars FROM documents, range(5) t(r) WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def pad_rows(spark, d):
    return R.pad_rows(_docs(spark, d, "n_chars"), 5)


@query("slice_step", "SELECT (doc_id - 10) // 7 AS _idx, n_chars FROM documents WHERE doc_id >= 10 AND doc_id < (SELECT count(*) FROM documents) - 20 AND (doc_id - 10) % 7 = 0")
def slice_step(spark, d):
    return R.slice_rows(_docs(spark, d, "n_chars"), 10, -20, 7)


@query("select_indices", "SELECT p AS _idx, n_chars FROM (VALUES (0, 5), (1, 3), (2, 3), (3, 90)) t(p, w) JOIN documents ON doc_id = w")
def select_indices(spark, d):
    return R.select_indices(_docs(spark, d, "n_chars"), [5, 3, 3, 90]).withColumn("_idx", F.col("_idx").cast("int"))


@query("drop_indices", "SELECT doc_id AS _idx FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def drop_indices(spark, d):
    return R.drop_indices(_docs(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("wanted")))


@query("batch_union", "SELECT d.doc_id AS _idx, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def batch_union(spark, d):
    right = table(spark, d, "labels").select(F.col("doc_id").alias("_idx"), "quality", "toxic")
    # A shared column must agree on both sides.
    right = right.join(_docs(spark, d, "n_chars"), "_idx")
    return R.union_columns(_docs(spark, d, "n_chars"), right)


@query("concat_rows", "SELECT doc_id AS _idx, text FROM documents UNION ALL SELECT (SELECT count(*) FROM documents) + item_id, text FROM benchmark")
def concat_rows(spark, d):
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("_idx"), "text")
    return R.concat(_docs(spark, d, "text"), bench)


@query("pop_rename", "SELECT doc_id AS _idx, lang AS language, source AS origin FROM documents")
def pop_rename(spark, d):
    _, popped = R.pop(_docs(spark, d, "lang", "source", "n_chars"), ["lang", "source"])
    return R.rename(popped, ["lang", "source"], ["language", "origin"])


@query("unfold_columns", "SELECT vec_id * 4 + r AS _idx, len(embedding[(r * 16 + 1):(r * 16 + 16)])::INT AS n, embedding[r * 16 + 1] AS head, label FROM embeddings, range(4) t(r)")
def unfold_columns(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("_idx"), "embedding", "label")
    out = R.unfold(rows, ["embedding"], 4)
    return out.select("_idx", F.size("embedding").alias("n"), F.get("embedding", F.lit(0)).alias("head"), "label")


# -- preference data ----------------------------------------------------------------------------

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
SQL_CANDIDATES = f"""
c AS (SELECT l_orderkey, list(l_extendedprice ORDER BY {ORDER}) AS s, list(l_partkey || '-' || l_linenumber ORDER BY {ORDER}) AS t FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, s, t, list_transform(list_zip(s, t), lambda z: z[1] - 0.5 * length(z[2])) AS r FROM c WHERE len(s) >= 2),
best AS (SELECT *, list_position(r, list_max(r)) AS hi, list_position(r, list_min(r)) AS lo FROM p)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    text = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    keys = [F.col(c.strip()) for c in ORDER.split(",")]
    listed = F.array_sort(F.collect_list(F.struct(*keys, text.alias("text"))))
    grouped = li.groupBy(F.col("l_orderkey").alias("_idx")).agg(listed.alias("l"))
    return grouped.select("_idx", F.concat(F.lit("order "), F.col("_idx").cast("string")).alias("input"), F.transform("l", lambda x: F.struct(x["l_extendedprice"].alias("score"), x["text"].alias("text"))).alias("output"))


def _pair_query(name: str, method: str, fast: bool, a: str, b: str, extra: str = "") -> None:
    sql = f"""
WITH {SQL_CANDIDATES}{extra}, q AS (SELECT *, {a} AS i, {b} AS j FROM best),
o AS (SELECT *, CASE WHEN r[i] > r[j] THEN i ELSE j END AS x, CASE WHEN r[i] > r[j] THEN j ELSE i END AS y FROM q)
SELECT l_orderkey AS _idx, 'order ' || l_orderkey AS prompt, t[x] AS chosen, t[y] AS rejected, round((s[x] - s[y]) * 0.1, 6) AS margin FROM o"""

    @query(name, sql)
    def run(spark, d):
        return preference.to_pairs(_candidates(spark, d), method, 0.5, 0.1, fast).withColumn("margin", F.round("margin", 6))


_pair_query("pairs_max_min", "max_min", False, "hi", "lo")
# Of equal scores the later candidate ranks higher among the two best.
_DESC = "list_sort(list_transform(range(1, len(r) + 1), lambda i: {'v': r[i], 'i': i}), 'DESC')"
_pair_query("pairs_max_max", "max_max", False, f"{_DESC}[1].i", f"{_DESC}[2].i")
_pair_query("pairs_fast_random", "random", True, "1", "2")
_pair_query("pairs_fast_max_random", "max_random", True, "hi", "CASE WHEN hi <> 1 THEN 1 ELSE 2 END")
_HASHED = "list_transform(list_sort(list_transform(range(0, len(r)), lambda i: {'h': md5('42:' || l_orderkey || ':' || i), 'i': i + 1})), lambda z: z.i)"
_pair_query("pairs_random", "random", False, f"{_HASHED}[1]", f"{_HASHED}[2]")
_pair_query("pairs_max_random", "max_random", False, "hi", f"list_filter({_HASHED}, lambda z: z <> hi)[1]")


@query(
    "best_of_k",
    """
WITH e AS (SELECT event_id AS _idx, user_id, CASE WHEN event_type = 'error' THEN -888888888.0::DOUBLE ELSE value END AS reward FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reward DESC, _idx) AS k FROM e)
SELECT user_id, _idx, reward FROM r WHERE k = 1 AND reward <> -888888888.0""",
)
def best_of_k(spark, d):
    reward = F.when(F.col("event_type") == "error", preference.DISCARDED).otherwise(F.col("value"))
    return preference.best_of(_events(spark, d).select("user_id", "_idx", reward.alias("reward")), "user_id", "reward", "_idx")


@query("top_alpha", "SELECT event_id AS _idx, value FROM events ORDER BY value DESC, event_id LIMIT (SELECT floor(count(*) * 0.29::DOUBLE)::BIGINT FROM events)")
def top_alpha(spark, d):
    return preference.top_share(_events(spark, d).select("_idx", "value"), 0.29, "value", "_idx")


@query(
    "best_then_top",
    """
WITH r AS (SELECT user_id, event_id AS _idx, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)
SELECT user_id, _idx, value FROM r WHERE k = 1 ORDER BY value DESC, _idx LIMIT 8""",
)
def best_then_top(spark, d):
    return preference.best_then_top(_events(spark, d).select("user_id", "_idx", "value"), "user_id", "value", "_idx", 8)


@query("score_attach", f"WITH {SQL_CANDIDATES} SELECT l_orderkey AS _idx, i::INT AS pos, s[i + 1] AS score, t[i + 1] AS text FROM c, (SELECT unnest(range(100)) AS i) WHERE i < len(s)")
def score_attach(spark, d):
    rows = _candidates(spark, d).select("_idx", F.col("output.text").alias("texts"), F.col("output.score").alias("scores"))
    joined = rows.select("_idx", preference.attach_scores(F.col("texts"), F.col("scores")).alias("o"))
    return joined.select("_idx", F.posexplode("o").alias("pos", "x")).select("_idx", "pos", "x.score", "x.text")


@query("flatten_regroup", f"WITH {SQL_CANDIDATES} SELECT l_orderkey AS _idx, md5(array_to_string(t, ',')) AS texts, len(t)::INT AS n FROM c")
def flatten_regroup(spark, d):
    rows = _candidates(spark, d).select("_idx", F.col("output.text").alias("texts"))
    back = preference.unflatten(preference.flatten(rows, "texts"))
    return back.select("_idx", F.md5(F.array_join("values", ",").cast("binary")).alias("texts"), F.size("values").alias("n"))


@query("regroup_rollouts", "SELECT event_id // 4 AS _idx, any_value(event_type ORDER BY event_id) AS input, array_to_string(list(value::INT ORDER BY event_id), ',') AS output FROM events GROUP BY 1")
def regroup_rollouts(spark, d):
    rows = _events(spark, d).withColumn("out", F.bround("value", 0).cast("int").cast("string"))
    return preference.regroup(rows, 4, "out", "event_type").select("_idx", "input", F.array_join("output", ",").alias("output"))


@query("candidate_check", f"WITH {SQL_CANDIDATES} SELECT l_orderkey AS _idx FROM c WHERE len(t) = 4")
def candidate_check(spark, d):
    rows = _candidates(spark, d).select("_idx", "input", F.col("output.text").alias("output"))
    return preference.valid_candidates(rows, width=4).select("_idx")


@query("reward_accuracy", "SELECT round(avg((a.value > b.value)::INT::DOUBLE), 6) AS acc, round(avg((a.value >= b.value)::INT::DOUBLE), 6) AS acc_ties FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_id % 2 = 0")
def reward_accuracy(spark, d):
    p, n = F.max(F.when(F.col("_idx") % 2 == 0, F.col("value"))), F.max(F.when(F.col("_idx") % 2 == 1, F.col("value")))
    pairs = _events(spark, d).groupBy(F.floor(F.col("_idx") / 2).alias("pair")).agg(p.alias("p"), n.alias("n")).where("p is not null and n is not null")
    return pairs.agg(F.round(losses.pair_accuracy(F.col("p"), F.col("n")), 6).alias("acc"), F.round(losses.pair_accuracy(F.col("p"), F.col("n"), True), 6).alias("acc_ties"))


@query("reward_loss", "SELECT round(avg(CASE WHEN x > 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END), 6) AS loss FROM (SELECT (a.value - b.value) / 10 AS x FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_id % 2 = 0)")
def reward_loss(spark, d):
    p, n = F.max(F.when(F.col("_idx") % 2 == 0, F.col("value"))), F.max(F.when(F.col("_idx") % 2 == 1, F.col("value")))
    pairs = _events(spark, d).groupBy(F.floor(F.col("_idx") / 2).alias("pair")).agg(p.alias("p"), n.alias("n")).where("p is not null and n is not null")
    return pairs.agg(F.round(losses.pair_loss(F.col("p") / 10, F.col("n") / 10), 6).alias("loss"))


LOGP = "c AS (SELECT l_returnflag, -l_quantity / 10 AS pc, -l_discount * 40 AS pr, -l_tax * 50 AS rc, -l_extendedprice / 30000 AS rr, l_quantity / 25 - 1 AS m FROM lineitem), x AS (SELECT *, (pc - pr - rc + rr) AS gap, 0.1 * (pc - pr - rc + rr) AS z, 1 / (1 + exp(-0.1 * (pc - pr - rc + rr))) AS p, 1 / (1 + exp(-m)) AS w FROM c)"
SQL_LOSS = {
    "sigmoid": "ln(1 + exp(-z))",
    "hinge": "greatest(0, 1 - z)",
    "cross_entropy": "ln(1 + exp(-0.1 * (pc - rc)))",
    "raft": "-pc",
    "ipo": "(gap - 5) ** 2",
    "kl": "least(p, 0.999) * (ln(least(p, 0.999)) - ln(exp(m) / (1 + exp(m) + 0.001))) + (1 - least(p, 0.999)) * (ln(1 - least(p, 0.999)) - ln(1 - exp(m) / (1 + exp(m) + 0.001)))",
    "tv": "abs(p - w)",
    "hellinger": "0.5 * ((sqrt(least(p, 0.999)) - sqrt(w)) ** 2 + (sqrt(1 - least(p, 0.999)) - sqrt(1 - w)) ** 2)",
    "rev_kl": "w * ln(1 + exp(-z)) + (1 - w) * ln(1 + exp(z))",
}


def _logps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_returnflag", (-F.col("l_quantity") / 10).alias("pc"), (-F.col("l_discount") * 40).alias("pr"), (-F.col("l_tax") * 50).alias("rc"), (-F.col("l_extendedprice") / 30000).alias("rr"), (F.col("l_quantity") / 25 - 1).alias("m")
    )


def _loss_query(kind: str) -> None:
    @query(f"pref_loss_{kind}", f"WITH {LOGP} SELECT l_returnflag, round(avg({SQL_LOSS[kind]}), 6) AS loss FROM x GROUP BY 1")
    def run(spark, d):
        loss = losses.preference_loss(kind, *map(F.col, ("pc", "pr", "rc", "rr")), margin=F.col("m"))
        return _logps(spark, d).groupBy("l_returnflag").agg(F.round(F.avg(loss), 6).alias("loss"))


for _kind in losses.KINDS:
    _loss_query(_kind)


@query("pref_metrics", f"WITH {LOGP} SELECT round(avg(0.1 * (pc - rc)), 6) AS chosen, round(avg(0.1 * (pr - rr)), 6) AS rejected, round(avg((pc - rc > pr - rr)::INT::DOUBLE), 6) AS accuracy, round(avg(0.1 * (pc - rc) - 0.1 * (pr - rr)), 6) AS margin FROM x")
def pref_metrics(spark, d):
    c, r = losses.rewards(F.col("pc"), F.col("rc")), losses.rewards(F.col("pr"), F.col("rr"))
    better = (F.col("pc") - F.col("rc")) > (F.col("pr") - F.col("rr"))
    return _logps(spark, d).agg(F.round(F.avg(c), 6).alias("chosen"), F.round(F.avg(r), 6).alias("rejected"), F.round(evaluation.accuracy(better), 6).alias("accuracy"), F.round(F.avg(c - r), 6).alias("margin"))


SQL_PREF = """
w AS (SELECT conv_id, turn, role, text, lead(text) OVER v AS a, lead(role) OVER v AS r, lead(text, 2) OVER v AS b FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, text AS p, a AS c, b AS j FROM w WHERE role = 'user' AND r = 'assistant' AND b IS NOT NULL),
n AS (SELECT *, greatest(length(c), length(j)) + 1 AS longest FROM t),
q AS (SELECT *, CASE WHEN length(p) + longest > 300 THEN right(p, 100) ELSE p END AS q FROM n),
o AS (SELECT *, length(q) + longest > 300 AS over FROM q),
s AS (SELECT conv_id, turn, q, CASE WHEN over THEN substr(c || chr(1), 1, 200) ELSE c || chr(1) END AS c, CASE WHEN over THEN substr(j || chr(1), 1, 200) ELSE j || chr(1) END AS j FROM o)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("p"), F.lead("text").over(w).alias("c"), F.lead("role").over(w).alias("r"), F.lead("text", 2).over(w).alias("j"))
    return rows.where("role = 'user' and r = 'assistant' and j is not null")


@query(
    "preference_tokens",
    f"""WITH {SQL_PREF}
SELECT conv_id, turn, length(q)::INT AS n_prompt, md5(array_to_string(list_transform(string_split(q || c, ''), lambda x: ord(x)), ',')) AS chosen,
  md5(array_to_string(list_concat(list_transform(range(length(q)), lambda x: -100), list_transform(string_split(j, ''), lambda x: ord(x))), ',')) AS rejected_labels FROM s""",
)
def preference_tokens(spark, d):
    row = tokens.preference_row(F.col("p"), F.col("c"), F.col("j"), tokens.codepoints, eos=1, max_length=300, max_prompt=100)
    rows = _triples(spark, d).select("conv_id", "turn", row.alias("r"))
    return rows.select("conv_id", "turn", F.size("r.prompt_input_ids").alias("n_prompt"), digest(F.col("r.chosen_input_ids")).alias("chosen"), digest(F.col("r.rejected_labels")).alias("rejected_labels"))


@query(
    "reward_rows",
    f"""WITH {SQL_PREF}, u AS (SELECT conv_id, turn, 0 AS side, p || c AS x FROM t UNION ALL SELECT conv_id, turn, 1, p || j FROM t)
SELECT conv_id, turn, side, least(length(x), 256)::INT AS used, md5(array_to_string(list_transform(string_split(rpad(substr(x, 1, 256), 256, chr(7)), ''), lambda c: ord(c)), ',')) AS ids FROM u""",
)
def reward_rows(spark, d):
    sides = F.array(F.concat("p", "c"), F.concat("p", "j"))
    rows = _triples(spark, d).select("conv_id", "turn", F.posexplode(sides).alias("side", "x"))
    ids = tokens.codepoints(F.col("x"))
    return rows.select("conv_id", "turn", "side", F.least(F.size(ids), F.lit(256)).alias("used"), digest(tokens.block(ids, 256, 7)).alias("ids"))


# -- evaluation ---------------------------------------------------------------------------------


@query("accuracy", "SELECT event_type, round(avg((value > 20)::INT::DOUBLE), 6) AS acc, count(*)::BIGINT AS n FROM events GROUP BY 1")
def accuracy(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.round(evaluation.accuracy(F.col("value") > 20), 6).alias("acc"), F.count("*").alias("n"))


@query("running_accuracy", "WITH b AS (SELECT event_id // 500 AS batch, sum((value > 20)::INT) AS c, count(*) AS n FROM events GROUP BY 1) SELECT batch, sum(c) OVER (ORDER BY batch)::BIGINT AS correct, sum(n) OVER (ORDER BY batch)::BIGINT AS processed FROM b")
def running_accuracy(spark, d):
    return evaluation.running_accuracy(_events(spark, d).withColumn("batch", F.floor(F.col("_idx") / 500)), "batch", F.col("value") > 20)


@query("benchmark_rollup", "SELECT lang AS dataset, count(*)::BIGINT AS n, round(avg(coalesce(quality, 0)::DOUBLE), 6) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def benchmark_rollup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("quality", F.lit(0)).cast("double")), 6).alias("score"))


@query(
    "retrieval_top4",
    """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(e, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS c FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id)::INT AS rank FROM s)
SELECT query_id, id, rank, round(c, 6) AS cosine FROM r WHERE rank <= 4""",
)
def retrieval_top4(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.top_similar(chunks, chunks.where("id % 100 = 0")).withColumn("cosine", F.round("cosine", 6))


# -- sample streams -----------------------------------------------------------------------------

SQL_RUNS = """
f AS (SELECT event_id, event_type, value, (lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type AND event_id <> (SELECT min(event_id) FROM events))::INT AS new FROM events),
g AS (SELECT event_id, event_type, value, sum(new) OVER (ORDER BY event_id)::BIGINT AS grp FROM f)"""


@query("consecutive_groups", f"WITH {SQL_RUNS} SELECT event_id AS _idx, grp AS \"group\" FROM g")
def consecutive_groups(spark, d):
    return samples.consecutive_groups(_events(spark, d).select("_idx", "event_type"), "event_type", "_idx").select("_idx", "group")


@query(
    "entry_samples",
    f"""
WITH {SQL_RUNS}, e AS (SELECT grp, event_type, event_id, value, (row_number() OVER (PARTITION BY grp ORDER BY event_id) - 1) // 3 AS piece FROM g)
SELECT grp AS "group", piece::INT AS piece, event_type AS key, count(*)::INT AS n, round(sum(value), 6) AS total FROM e GROUP BY 1, 2, 3""",
)
def entry_samples(spark, d):
    # Suffixes come in turn (a, b, c), so a run is cut after every third entry.
    runs = samples.consecutive_groups(_events(spark, d).select("_idx", "event_type", "value"), "event_type", "_idx")
    from pyspark.sql import Window

    turn = (F.row_number().over(Window.partitionBy("group").orderBy("_idx")) - 1) % 3
    entries = runs.withColumn("suffix", F.element_at(F.array(F.lit("a"), F.lit("B"), F.lit("c")), turn + 1)).drop("group")
    out = samples.group_entries(entries, "event_type", "suffix", "value", "_idx")
    total = F.aggregate(F.map_values("sample"), F.lit(0.0), lambda a, x: a + x)
    return out.select("group", "piece", "key", F.size("sample").alias("n"), F.round(total, 6).alias("total"))


@query("json_metadata_filter", "SELECT event_id AS _idx FROM events WHERE coalesce(nullif(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0), 1.0) <= 50 AND coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) >= 10")
def json_metadata_filter(spark, d):
    return _events(spark, d).where(samples.metadata_passes(F.col("props"), 10, 50, "k", "k", "k")).select("_idx")


@query("map_keys", "SELECT event_id AS _idx, event_type AS picked, 2::INT AS n FROM events")
def map_keys(spark, d):
    sample = F.create_map(F.lit("jpg"), F.lit(None).cast("string"), F.lit("png"), F.col("event_type"), F.lit("txt"), F.col("props"))
    return _events(spark, d).select("_idx", samples.first_present(sample, ["jpg", "png"]).alias("picked"), F.size(samples.keep_keys(sample, ["png", "txt", "json"])).alias("n"))


@query("buffered_shuffle", "SELECT event_id // 1000 * 1000 + row_number() OVER (PARTITION BY event_id // 1000 ORDER BY md5('42:' || event_id), event_id) - 1 AS _idx, event_id FROM events")
def buffered_shuffle(spark, d):
    return samples.buffered_shuffle(_events(spark, d).select("_idx", F.col("_idx").alias("event_id")))


@query("caption_choice", "SELECT event_id AS _idx, CASE WHEN ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.1 THEN '' ELSE event_type END AS caption FROM events")
def caption_choice(spark, d):
    return _events(spark, d).select("_idx", samples.choose_caption(F.array("event_type", "props"), F.col("_idx"), drop=0.1).alias("caption"))


@query("preference_orientation", "SELECT event_id AS _idx, CASE WHEN value < 20 THEN props ELSE event_type END AS first FROM events")
def preference_orientation(spark, d):
    pair = samples.oriented(F.when(F.col("value") < 20, 0).otherwise(1), F.col("event_type"), F.col("props"))
    return _events(spark, d).select("_idx", F.get(pair, F.lit(0)).alias("first"))
