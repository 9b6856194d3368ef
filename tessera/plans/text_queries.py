"""Queries over text functions, tokens, blocks, conversations and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers, chat, text, tokens
from tessera.operators import conversations, evaluation, packing
from tessera.plans.registry import query, table

SIZE = 128


def digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ",").cast("binary"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


SQL_IDS = "list_transform(string_split(text, ''), lambda c: ord(c))"


def sql_digest(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


@query(
    "dataset_stats",
    f"""
WITH t AS (SELECT list_slice({SQL_IDS}, 1, {SIZE}) AS ids FROM documents WHERE length(text) > 0),
     c AS (SELECT len(list_filter(ids, lambda x: x <> 0)) AS tokens, len(ids) AS targets FROM t)
SELECT count(*)::BIGINT AS n_rows, sum(tokens)::BIGINT AS total_tokens, sum(targets)::BIGINT AS target_tokens,
       round(avg(tokens), 6) AS avg_tokens, round(avg(targets), 6) AS avg_targets FROM c""",
)
def dataset_stats(spark, d):
    rows = _docs(spark, d).select(tokens.block_row(tokens.text_only(F.col("text"), tokens.codepoints), SIZE).alias("r")).where(tokens.has_target(F.col("r.labels")))
    return evaluation.dataset_statistics(rows, F.col("r.input_ids"), F.col("r.labels"))


@query("codepoint_tokens_digest", f"SELECT doc_id, length(text)::INT AS n, {sql_digest(SQL_IDS)} AS ids FROM documents")
def codepoint_tokens_digest(spark, d):
    ids = tokens.codepoints(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(ids).alias("n"), digest(ids).alias("ids"))


@query("codepoint_round_trip", "SELECT doc_id, md5(text) AS decoded FROM documents")
def codepoint_round_trip(spark, d):
    back = tokens.from_codepoints(tokens.codepoints(F.col("text")))
    return _docs(spark, d).select("doc_id", F.md5(back.cast("binary")).alias("decoded"))


@query(
    "block_pad_truncate",
    f"""
WITH t AS (SELECT doc_id, {SQL_IDS} AS ids FROM documents),
     p AS (SELECT *, greatest({SIZE} - len(ids), 0) AS k FROM t)
SELECT doc_id, {sql_digest(f"list_concat(list_slice(ids, 1, {SIZE}), list_transform(range(k), lambda x: 0))")} AS right_ids,
       {sql_digest(f"list_concat(list_slice(ids, 1, {SIZE}), list_transform(range(k), lambda x: -100))")} AS right_labels,
       {sql_digest(f"list_concat(list_transform(range(k), lambda x: 0), list_slice(ids, greatest(len(ids) - {SIZE}, 0) + 1, len(ids)))")} AS left_ids,
       {SIZE} - k::INT AS used FROM p""",
)
def block_pad_truncate(spark, d):
    row = tokens.text_only(F.col("text"), tokens.codepoints)
    rows = _docs(spark, d).select("doc_id", tokens.block_row(row, SIZE).alias("r"), tokens.block_row(row, SIZE, side="left", cut="left").alias("l"))
    used = F.aggregate("r.attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.where(tokens.has_target(F.col("r.labels"))).select("doc_id", digest(F.col("r.input_ids")).alias("right_ids"), digest(F.col("r.labels")).alias("right_labels"), digest(F.col("l.input_ids")).alias("left_ids"), used.alias("used"))


SQL_PAIRS = """
n AS (SELECT conv_id, turn, role, text AS input, lead(role) OVER w AS next_role, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, input, output FROM n WHERE role = 'user' AND next_role = 'assistant')"""


@query(
    "text2text_labels",
    f"""
WITH {SQL_PAIRS}
SELECT conv_id, turn, (length(input) + length(output))::INT AS n,
  md5(array_to_string(list_concat(list_transform(range(length(input)), lambda x: -100), list_transform(string_split(output, ''), lambda c: ord(c))), ',')) AS labels FROM pairs""",
)
def text2text_labels(spark, d):
    row = tokens.text_to_text(F.col("input"), F.col("output"), tokens.codepoints)
    rows = conversations.neighbours(table(spark, d, "conversations")).select("conv_id", "turn", row.alias("r"))
    return rows.select("conv_id", "turn", F.size("r.input_ids").alias("n"), digest(F.col("r.labels")).alias("labels"))


@query(
    "text2text_truncated",
    f"""
WITH {SQL_PAIRS}
SELECT conv_id, turn, (least(length(input), 40) + least(length(output), 40))::INT AS n,
  md5(array_to_string(list_transform(string_split(substr(input, 1, 40) || substr(output, 1, 40), ''), lambda c: ord(c)), ',')) AS ids FROM pairs""",
)
def text2text_truncated(spark, d):
    row = tokens.text_to_text(F.col("input"), F.col("output"), tokens.codepoints, max_length=40)
    rows = conversations.neighbours(table(spark, d, "conversations")).select("conv_id", "turn", row.alias("r"))
    return rows.select("conv_id", "turn", F.size("r.input_ids").alias("n"), digest(F.col("r.input_ids")).alias("ids"))


@query(
    "loss_filter",
    "WITH l AS (SELECT doc_id, text, position('.' IN text) AS cut FROM documents) SELECT doc_id, (length(text) - cut)::INT AS learned FROM l WHERE cut > 0 AND length(text) > cut",
)
def loss_filter(spark, d):
    # Everything up to the first full stop is prompt.
    cut = F.when(F.instr("text", ".") > 0, F.instr("text", ".")).otherwise(F.length("text"))
    learned = F.substring("text", cut + 1, F.length("text"))
    labels = F.concat(tokens.ignored(cut), tokens.codepoints(learned))
    rows = _docs(spark, d).select("doc_id", labels.alias("labels")).where(tokens.has_target(F.col("labels")))
    return rows.select("doc_id", tokens.count_where(F.col("labels"), lambda x: x != tokens.IGNORED).alias("learned"))


@query("valid_label_counts", "SELECT doc_id, (length(text) - 1)::INT AS n FROM documents WHERE length(text) > 0")
def valid_label_counts(spark, d):
    rows = _docs(spark, d).where(F.length("text") > 0).select("doc_id", tokens.codepoints(F.col("text")).alias("labels"))
    return rows.select("doc_id", tokens.valid_label_count(F.col("labels")).alias("n"))


def _pack_sql(size: int, short: bool) -> str:
    keep = f"OR length(t) < {size}" if short else ""
    return f"""
WITH g AS (SELECT doc_id // 100 AS grp, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1),
     b AS (SELECT grp, t, unnest(range(greatest(length(t) // {size}, {1 if short else 0}))) AS block FROM g WHERE length(t) >= {size} {keep})
SELECT grp AS "group", block, length(substr(t, block * {size} + 1, {size}))::INT AS n,
  md5(array_to_string(list_transform(string_split(substr(t, block * {size} + 1, {size}), ''), lambda c: ord(c)), ',')) AS ids FROM b"""


def _pack(spark, d, size, short):
    rows = _docs(spark, d).select(F.col("doc_id").alias("_idx"), tokens.codepoints(F.col("text")).alias("input_ids"))
    out = packing.pack(rows, ["input_ids"], size, group=100, keep_short=short)
    return out.select("group", "block", F.size("input_ids").alias("n"), digest(F.col("input_ids")).alias("ids"))


@query("pack_blocks", _pack_sql(512, False))
def pack_blocks(spark, d):
    return _pack(spark, d, 512, False)


@query("pack_blocks_keep_short", _pack_sql(200_000, True))
def pack_blocks_keep_short(spark, d):
    return _pack(spark, d, 200_000, True)


# -- text ---------------------------------------------------------------------------------------


@query(
    "raft_discard",
    """
WITH c AS (SELECT doc_id, text, list_filter(string_split(text, '###Human'), lambda x: x <> '')[1] AS p FROM documents),
     g AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(p, ''), '^[\\s]+|[\\s]+$', '', 'g'), '^#+|#+$', '', 'g') AS t FROM c)
SELECT doc_id, md5(t) AS cleaned, CASE WHEN contains(t, '#') OR length(t) < 2 THEN -888888888.0::DOUBLE ELSE length(t)::DOUBLE END AS reward FROM g""",
)
def raft_discard(spark, d):
    rows = _docs(spark, d).withColumn("t", text.clean_generation(F.col("text")))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("cleaned"), text.discard_score(F.col("t"), F.length("t").cast("double")).alias("reward"))


@query(
    "text_chunks",
    """
WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 380)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, (s // 380)::INT AS pos, md5(substr(text, s + 1, 400)) AS chunk FROM c""",
)
def text_chunks(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("pos", "c"))
    return rows.select("doc_id", "pos", F.md5(F.col("c").cast("binary")).alias("chunk"))


@query("squeeze_newlines", "SELECT doc_id, md5(regexp_replace(text, '\\n+', chr(10), 'g')) AS t FROM documents")
def squeeze_newlines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.squeeze_newlines(F.col("text")).cast("binary")).alias("t"))


@query("cut_end_string", "SELECT page_id, md5(split_part(html, '</title>', 1)) AS t, contains(html, '</title>') AS found FROM pages")
def cut_end_string(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(text.cut_at(html, "</title>").cast("binary")).alias("t"), text.has_stop(html, "</title>").alias("found"))


@query(
    "prompt_structures",
    """
SELECT item_id, md5(replace('Question: {input}' || chr(10) || 'Answer:', '{input}', text)) AS prompt, md5(substr(text || ' yes.', length(text) + 1)) AS answer,
  md5(replace('a ' || text || ' b ' || text, text, '')) AS removed, right(text, 64) AS memory FROM benchmark""",
)
def prompt_structures(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id",
        F.md5(text.fill_prompt("Question: {input}\nAnswer:", t).cast("binary")).alias("prompt"),
        F.md5(text.strip_prefix(F.concat(t, F.lit(" yes.")), t).cast("binary")).alias("answer"),
        F.md5(text.remove_all(F.concat(F.lit("a "), t, F.lit(" b "), t), t).cast("binary")).alias("removed"),
        text.tail(t, 64).alias("memory"),
    )


@query(
    "image_tags",
    """
WITH b AS (SELECT item_id, substr(text, 1, 20) AS a, substr(text, 21) AS z FROM benchmark)
SELECT item_id, '<image>' || chr(10) || regexp_replace(a || z, '^[\\s]+|[\\s]+$', '', 'g') AS tagged, a || z AS bare, [length(a), length(a || z)]::VARCHAR AS positions FROM b""",
)
def image_tags(spark, d):
    t = F.col("text")
    a, z = F.substring(t, 1, 20), F.substring(t, F.lit(21), F.length(t))
    rows = table(spark, d, "benchmark").select("item_id", F.concat(a, F.lit("<image>"), z).alias("x"), F.concat(a, F.lit("<ImageHere>"), z, F.lit("<ImageHere>")).alias("y"))
    spots = text.image_positions(F.col("y"))
    listed = F.concat(F.lit("["), F.array_join(spots["positions"].cast("array<string>"), ", "), F.lit("]"))
    return rows.select("item_id", text.image_tag_first(F.col("x")).alias("tagged"), spots["text"].alias("bare"), listed.alias("positions"))


@query(
    "image_token_splice",
    """
WITH b AS (SELECT item_id, substr(text, 1, 10) AS a, substr(text, 11) AS z FROM benchmark)
SELECT item_id, md5(array_to_string(list_concat(list_concat(list_transform(string_split(a, ''), lambda c: ord(c)), [-200]), list_transform(string_split(z, ''), lambda c: ord(c))), ',')) AS ids,
  (length(a) + length(z) + 4)::INT AS widened FROM b""",
)
def image_token_splice(spark, d):
    t = F.col("text")
    ids = tokens.splice_images(F.concat(F.substring(t, 1, 10), F.lit("<image>"), F.substring(t, F.lit(11), F.length(t))), tokens.codepoints)
    rows = table(spark, d, "benchmark").select("item_id", ids.alias("i"))
    return rows.select("item_id", digest(F.col("i")).alias("ids"), F.size(tokens.widen_images(F.col("i"), F.col("i"), 4)).alias("widened"))


@query("argument_lists", "SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), '|') AS items FROM part")
def argument_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_argument(F.replace("p_type", F.lit(" "), F.lit(" , "))), "|").alias("items"))


# -- answers ------------------------------------------------------------------------------------

RESPONSE = {
    "answer_math": ("gsm8k", "'The total is 1,' || l_orderkey || ' and then ' || CASE WHEN l_linenumber = 3 THEN 'none' ELSE l_extendedprice::VARCHAR || '.' END"),
    "answer_choice": ("aqua", "'I think ' || CASE l_linenumber % 4 WHEN 0 THEN 'B or C' WHEN 1 THEN 'D.' WHEN 2 THEN 'e' ELSE 'Answer: E' END"),
    "answer_yesno": ("strategyqa", "CASE l_linenumber % 4 WHEN 0 THEN 'Yes, it is: no.' WHEN 1 THEN 'NO' WHEN 2 THEN 'maybe' ELSE 'well \"yes\"' END"),
    "answer_last_letters": ("last_letters", "'a b. ' || l_returnflag || ' \"' || l_linestatus || '\"'"),
    "answer_pubmedqa": ("pubmedqa", "CASE l_linenumber % 4 WHEN 0 THEN 'Answer: (Yes).' WHEN 1 THEN 'Maybe ' WHEN 2 THEN 'who knows' ELSE 'so NO.' END"),
    "answer_medmcqa": ("medmcqa", "CASE l_linenumber % 4 WHEN 0 THEN 'ANSWER: (C) x' WHEN 1 THEN 'it is (b).' WHEN 2 THEN '2 + 2' ELSE 'output: d' END"),
    "answer_usmle": ("usmle", "CASE l_linenumber % 4 WHEN 0 THEN 'answer: (C' WHEN 1 THEN 'it is b ' WHEN 2 THEN '2 + 2' ELSE 'Output: d' END"),
}
_MAYBE = "yes|Yes|YES|no|No|NO|maybe|Maybe|MAYBE"
_LABEL = "answer|Answer|ANSWER|output|Output|OUTPUT|A"
SQL_ANSWER = {
    "gsm8k": "coalesce(round_even(try_cast(regexp_replace(list_last(regexp_extract_all(replace(r, ',', ''), '-?[0-9]+\\.?[0-9]*')), '\\.$', '') AS DOUBLE), 0)::BIGINT::VARCHAR, '')",
    "aqua": "coalesce(list_last(regexp_extract_all(r, '[A-E]')), '')",
    "strategyqa": "coalesce(list_last(list_filter(string_split(regexp_replace(lower(r), '[\"''\\n.\\s:,]', ' ', 'g'), ' '), lambda w: w IN ('yes', 'no'))), '')",
    "last_letters": "regexp_replace(r, '[\"''\\n.\\s]', '', 'g')",
    "pubmedqa": f"lower(coalesce(nullif(regexp_extract(r, '({_LABEL}): \\(*({_MAYBE})', 2), ''), nullif(regexp_extract(r, '({_MAYBE})[.\\s]', 1), ''), '~'))",
    "medmcqa": f"lower(coalesce(nullif(regexp_extract(r, '({_LABEL}): \\(*([A-Da-d])', 2), ''), nullif(regexp_extract(r, '([A-Da-d])\\)*[.\\s]', 1), ''), '~'))",
    "usmle": "lower(coalesce(nullif(regexp_extract(r, '(Answer|Output|A): \\(*([A-Da-d])', 2), ''), nullif(regexp_extract(r, '([A-Da-d])\\)*[.\\s]', 1), ''), '~'))",
}


def _answer_query(name: str, kind: str, response: str) -> None:
    sql = f"""
WITH t AS (SELECT l_linenumber, {response} AS r FROM lineitem), e AS (SELECT l_linenumber, r, {SQL_ANSWER[kind]} AS a FROM t)
SELECT l_linenumber, CASE WHEN a = '~' THEN 'N/A' ELSE a END AS answer, count(*)::BIGINT AS n FROM e GROUP BY 1, 2"""

    @query(name, sql)
    def run(spark, d):
        spark_sql = response.replace("l_orderkey || '", "cast(l_orderkey as string) || '").replace("l_extendedprice::VARCHAR", "cast(cast(l_extendedprice as decimal(18,2)) as string)")
        rows = table(spark, d, "lineitem").select("l_linenumber", F.expr(spark_sql).alias("r"))
        return rows.groupBy("l_linenumber", answers.extract(F.col("r"), kind).alias("answer")).agg(F.count("*").alias("n"))


for _name, (_kind, _response) in RESPONSE.items():
    _answer_query(_name, _kind, _response)


# -- conversations ------------------------------------------------------------------------------

SQL_CONV = """
m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS all_m FROM conversations GROUP BY conv_id),
conv AS (SELECT conv_id, CASE WHEN all_m[1].role = 'system' THEN all_m[1].content END AS sys,
                CASE WHEN all_m[1].role = 'system' THEN list_slice(all_m, 2, len(all_m)) ELSE all_m END AS msgs FROM m),
valid AS (SELECT conv_id, sys, CASE WHEN len(msgs) >= 2 AND msgs[1].role = 'user' THEN len(msgs) // 2 ELSE 0 END AS rounds, msgs FROM conv)"""


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return conversations.from_turns(table(spark, d, "conversations"))


@query("conversation_rows", f"WITH {SQL_CONV} SELECT conv_id, sys AS system, len(msgs)::INT AS n FROM conv")
def conversation_rows(spark, d):
    return _conv(spark, d).select("conv_id", "system", F.size("messages").alias("n"))


@query("conversation_validity", f"WITH {SQL_CONV} SELECT conv_id, (rounds * 2)::INT AS n_used FROM valid")
def conversation_validity(spark, d):
    return _conv(spark, d).select("conv_id", F.size(chat.valid_messages(F.col("messages"))).alias("n_used"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_parts(parts: chat.Parts, content: str) -> str:
    out = []
    for p in parts:
        if isinstance(p, chat.Token):
            out.append({"bos": "'<s>'", "eos": "'</s>'"}[p.name])
        elif isinstance(p, str):
            out.append(_quoted(p).replace(chat.SLOT, f"' || {content} || '") if chat.SLOT in p else _quoted(p))
    return " || ".join(f"({x})" for x in out) or "''"


def _render_sql(t: chat.Template, select: str) -> str:
    q, a = "msgs[2 * i + 1].content", "msgs[2 * i + 2].content"
    head = f"CASE WHEN trim(coalesce(sys, '')) <> '' THEN {_sql_parts(t.system, 'sys')} ELSE {_sql_parts(t.system, chr(39) * 2) if t.force_system else chr(39) * 2} END" if t.system else "''"
    if t.system_in_user:
        user = _sql_parts(t.user, f"(CASE WHEN i = 0 THEN {head} ELSE '' END || {q})")
    else:
        bare = tuple(p.replace("\n", "", 1) if k == 0 and isinstance(p, str) else p for k, p in enumerate(t.user)) if t.no_first_newline else t.user
        body = f"CASE WHEN i = 0 AND trim(coalesce(sys, '')) = '' THEN {_sql_parts(bare, q)} ELSE {_sql_parts(t.user, q)} END"
        user = f"CASE WHEN i = 0 THEN {head} ELSE '' END || {body}"
    if t.starter is not None:
        user = f"CASE WHEN i = 0 THEN {_sql_parts((t.starter,), '')} ELSE '' END || {user}"
    said = _sql_parts(t.assistant, a)
    if t.stopper is not None:
        said = f"{said} || CASE WHEN i = rounds - 1 THEN {_sql_parts((t.stopper,), '')} ELSE '' END"
    return f"""
WITH {SQL_CONV}, r AS (SELECT *, unnest(range(rounds)) AS i FROM valid WHERE rounds > 0),
t AS (SELECT conv_id, i::INT AS round, {user} AS u, {said} AS a FROM r) {select}"""


def _render_query(name: str) -> None:
    t = chat.preset(name)

    @query(f"render_{name}", _render_sql(t, "SELECT conv_id, round, u AS user_text, a AS assistant_text FROM t"))
    def run(spark, d):
        system = F.col("system") if t.system else None
        rows = _conv(spark, d).select("conv_id", F.posexplode(chat.render(t, chat.valid_messages(F.col("messages")), system)).alias("round", "p"))
        return rows.select("conv_id", "round", F.col("p.user").alias("user_text"), F.col("p.assistant").alias("assistant_text"))


for _name in ("chatml", "chatglm3", "deepseek_v2", "empty", "empty_no_special_tokens", "gemma", "hymba", "internlm2", "llama2", "llama3", "phi3", "qwen2", "yi1_5", "zephyr"):
    _render_query(_name)


@query(
    "conversation_tokenized",
    _render_sql(
        chat.preset("chatml"),
        """, x AS (SELECT conv_id, string_agg(u || a, '' ORDER BY round) AS ids,
          string_agg(repeat('-100,', length(u)::INT) || array_to_string(list_transform(string_split(a, ''), lambda c: ord(c)), ','), ',' ORDER BY round) AS labels FROM t GROUP BY conv_id)
SELECT conv_id, length(ids)::INT AS n, md5(array_to_string(list_transform(string_split(ids, ''), lambda c: ord(c)), ',')) AS ids, md5(labels) AS labels FROM x""",
    ),
)
def conversation_tokenized(spark, d):
    row = chat.tokenized(chat.preset("chatml"), F.col("messages"), tokens.codepoints, 1, 2, F.col("system"))
    rows = _conv(spark, d).select("conv_id", row.alias("r")).where(F.size("r.input_ids") > 0)
    return rows.select("conv_id", F.size("r.input_ids").alias("n"), digest(F.col("r.input_ids")).alias("ids"), digest(F.col("r.labels")).alias("labels"))


@query(
    "tool_groups",
    """
WITH g AS (SELECT conv_id, turn, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
           FROM conversations WHERE role <> 'system')
SELECT conv_id, k::INT AS grp, count(*)::INT AS n FROM g GROUP BY 1, 2""",
)
def tool_groups(spark, d):
    rows = _conv(spark, d).select("conv_id", F.posexplode(chat.tool_turns(F.col("messages"))).alias("grp", "g"))
    return rows.select("conv_id", "grp", F.size("g").alias("n"))


@query(
    "conversation_context_expand",
    "SELECT conv_id, turn, md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS context FROM conversations",
)
def conversation_context_expand(spark, d):
    return conversations.with_context(table(spark, d, "conversations")).select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context"))


@query(
    "inference_prompt_gate",
    f"WITH {SQL_CONV} SELECT conv_id, msgs[1].content AS prompt FROM conv WHERE len(msgs) > 0 AND msgs[len(msgs)].role = 'user' AND length(msgs[1].content) > 0",
)
def inference_prompt_gate(spark, d):
    rows = _conv(spark, d).where(F.size("messages") > 0).select("conv_id", chat.inference_prompt(F.col("messages")).alias("prompt"))
    return rows.where(F.length("prompt") > 0)


# -- windows and likelihoods --------------------------------------------------------------------

WINDOWS_SQL = """
w AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 512)) AS b FROM documents WHERE length(text) > 0),
win AS (SELECT doc_id, b AS "begin", least(b + 700, n)::BIGINT AS "end", CASE WHEN b = 0 THEN 0 ELSE least(b - 512 + 700, n) END::BIGINT AS scored_from, n FROM w)"""


@query("eval_windows", f'WITH {WINDOWS_SQL} SELECT doc_id, "begin", "end", scored_from FROM win WHERE scored_from < n')
def eval_windows(spark, d):
    return evaluation.eval_windows(_docs(spark, d), F.length("text"), 512, 700).select("doc_id", "begin", "end", "scored_from")


UNIGRAM_SQL = f"""
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE length(text) > 0),
f AS (SELECT ch, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM c GROUP BY ch),
s AS (SELECT c.doc_id, c.pos, f.lp FROM c JOIN f USING (ch)), {WINDOWS_SQL},
nll AS (SELECT win.doc_id, win."begin", -avg(s.lp) AS nll, -sum(s.lp) AS total FROM win JOIN s ON s.doc_id = win.doc_id AND s.pos >= greatest(win.scored_from, win."begin" + 1) AND s.pos < win."end"
        WHERE win.scored_from < win.n GROUP BY 1, 2)"""


def _window_nll(spark, d):
    rows = _docs(spark, d).where(F.length("text") > 0).select("doc_id", tokens.codepoints(F.col("text")).alias("ids"))
    scored = evaluation.unigram_logprobs(rows, "ids", "doc_id").select("doc_id", "logprobs")
    windows = evaluation.eval_windows(scored, F.size("logprobs"), 512, 700)
    return windows.select("doc_id", "begin", evaluation.window_nll(F.col("logprobs"), F.col("begin"), F.col("end"), F.col("scored_from")).alias("nll")).where("nll is not null")


@query("nll_unigram", f"WITH {UNIGRAM_SQL} SELECT doc_id, count(*)::BIGINT AS windows, round(sum(nll), 6) AS nll FROM nll GROUP BY 1")
def nll_unigram(spark, d):
    return _window_nll(spark, d).groupBy("doc_id").agg(F.count("*").alias("windows"), F.round(F.sum("nll"), 6).alias("nll"))


@query("ppl_unigram", f"WITH {UNIGRAM_SQL} SELECT round(exp(avg(nll)), 5) AS ppl, count(*)::BIGINT AS windows FROM nll")
def ppl_unigram(spark, d):
    return _window_nll(spark, d).agg(F.round(F.exp(F.avg("nll")), 5).alias("ppl"), F.count("*").alias("windows"))


@query(
    "token_accuracy",
    """
WITH t AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 1)
SELECT doc_id, round(list_sum(list_transform(list_zip(list_slice(c, 1, len(c) - 1), list_slice(c, 2, len(c))), lambda z: (z[1] = z[2])::INT)) / (len(c) - 1), 6) AS acc FROM t""",
)
def token_accuracy(spark, d):
    # The prediction is that each character repeats.
    ids = tokens.codepoints(F.col("text"))
    rows = _docs(spark, d).where(F.length("text") > 1).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.round(evaluation.token_accuracy(F.col("ids"), F.col("ids")), 6).alias("acc"))
