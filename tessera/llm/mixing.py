"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Token weights of the cells (source x language x topic) are raked to each
marginal in turn until they settle; ``rate`` times a cell's raked weight over
its tokens is how often each of its documents is expected.  A cell that is asked
for more tokens than it has is repeated: the whole part of that number is copies
that every document gets, the fraction is drawn, so the targets are met in
expectation whatever the corpus has.
A category that the targets don't name falls under ``*``, so the number of
cells is bounded by the product of the targets' sizes.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
REST = "*"
#: Raking ends when a whole round moves no weight by more than this share of it; targets that contradict each other end after ``ROUNDS``.
SETTLED = 1e-12
ROUNDS = 300

Targets = Mapping[str, Mapping[str, float]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def _category(column: Column, shares: Mapping[str, float]) -> Column:
    return F.when(column.isin([k for k in shares if k != REST]), column.cast("string")).otherwise(F.lit(REST))


def _share(column: Column, shares: Mapping[str, float]) -> Column:
    case = F.lit(float(shares.get(REST, 0.0)))
    for k, v in shares.items():
        if k != REST:
            case = F.when(column == k, F.lit(float(v))).otherwise(case)
    return case


def rake(cells: DataFrame, names: list[str], targets: Targets, rounds: int = ROUNDS) -> DataFrame:
    """Cells with their raked weight in tokens (as many in all as there are): one row holds them all, and higher-order functions fit it.

    The targets of categories that no cell has are left out and the others take
    their place in proportion.
    """
    fields = [F.col(c) for c in names] + [_share(F.col(c), targets[c]).alias(f"{c}__share") for c in names] + [F.col("tokens").cast("double").alias("tokens")]
    one = cells.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cells")).where(F.size("cells") > 0)
    one = one.withColumn("weights", F.transform("cells", lambda c: c["tokens"]))

    def fit(weights: Column, name: str) -> Column:
        pairs = F.arrays_zip(F.col("cells").alias("c"), weights.alias("w"))

        def total(of: Column) -> Column:
            return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.when(x["c"][name] == of, x["w"]).otherwise(0.0))

        return F.transform(pairs, lambda x: F.when(total(x["c"][name]) > 0, x["w"] * x["c"][f"{name}__share"] / total(x["c"][name])).otherwise(0.0))

    steps = F.sequence(F.lit(0), F.lit(rounds * len(names) - 1))
    start = F.struct(F.col("weights").alias("w"), F.lit(0).alias("calm"))

    def step(state: Column, k: Column) -> Column:
        out = fit(state["w"], names[-1])
        for i, name in enumerate(names[:-1]):
            out = F.when(k % len(names) == i, fit(state["w"], name)).otherwise(out)

        def judged(new: Column) -> Column:
            moved = F.exists(F.zip_with(state["w"], new, lambda x, y: F.abs(y - x) > SETTLED * x), lambda x: x)
            return F.struct(new.alias("w"), F.when(moved, 0).otherwise(state["calm"] + 1).alias("calm"))

        return F.when(state["calm"] >= len(names), state).otherwise(F.get(F.transform(F.array(out), judged), F.lit(0)))

    one = one.withColumn("weights", F.aggregate(steps, start, step, lambda s: s["w"]))
    sum_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    scale = sum_of(F.transform("cells", lambda c: c["tokens"])) / F.nullif(sum_of(F.col("weights")), F.lit(0.0))
    one = one.withColumn("scale", scale).withColumn("weights", F.transform("weights", lambda w: w * F.col("scale")))
    flat = one.select(F.explode(F.arrays_zip(F.col("cells").alias("c"), F.col("weights").alias("w"))).alias("x"))
    return flat.select(*[F.col(f"x.c.{c}").alias(c) for c in names], F.col("x.c.tokens").alias("tokens"), F.col("x.w").alias("weight"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, targets: Targets, doc_id: str = "doc_id", text: str = "text", rate: float = 1.0, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_tokens``, ``expected``, ``probability``, ``sampled`` and ``copies``.

    The sample has each row ``copies`` times, ``expected`` on average;
    ``probability`` is the chance that this is at least once, and ``sampled``
    says whether it is.  ``targets`` names existing columns (such as source,
    lang, topic) and the share of tokens that each of their values should have.  Rows without words
    weigh nothing and get probability 1 and one copy; null categories fall under
    ``*``.  Repeated rows share their draw.  Existing columns of the added names
    are replaced.
    """
    if not targets or not 0 < rate <= 1:
        raise ValueError("targets must not be empty, and rate must be in (0, 1]")
    names = list(targets)
    docs = docs.drop("n_tokens", "expected", "probability", "sampled", "copies")
    cats = [f"__{c}" for c in names]
    rows = docs.withColumns({"n_tokens": word_count(F.col(text)), **{f"__{c}": _category(F.col(c), targets[c]) for c in names}})
    cells = rows.groupBy(*cats).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    raked = rake(cells, cats, {f"__{c}": targets[c] for c in names}, rounds).withColumn("ratio", F.col("weight") / F.col("tokens"))
    # At most as many rows as there are combinations of named categories.
    few = raked.select(*cats, F.round(F.col("ratio") * rate, 9).alias("__expected"))
    joined = rows.join(F.broadcast(few), cats, "left").drop(*cats)
    expected = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.coalesce("__expected", F.lit(0.0)))
    joined = joined.withColumn("expected", expected).withColumn("probability", F.least("expected", F.lit(1.0))).drop("__expected")
    drawn = uniform(F.col(doc_id), seed)
    copies = F.floor("expected") + (drawn < F.col("expected") - F.floor("expected")).cast("long")
    return joined.withColumns({"sampled": drawn < F.col("probability"), "copies": copies})


def achieved(mixed: DataFrame, targets: Targets) -> DataFrame:
    """For every target: name, category, target, and the shares of tokens in the corpus, expected and drawn."""
    weights = {"corpus": F.lit(1.0), "expected": F.col("expected"), "drawn": F.col("copies").cast("double")}
    each = [F.struct(F.lit(c).alias("name"), _category(F.col(c), targets[c]).alias("category")) for c in targets]
    sums = mixed.select(F.explode(F.array(*each)).alias("x"), *[(F.col("n_tokens") * w).alias(k) for k, w in weights.items()])
    sums = sums.groupBy("x.name", "x.category").agg(*[F.sum(k).alias(k) for k in weights])
    # One row for each named category.
    whole = Window.partitionBy("name")
    case = reduce(lambda a, c: F.when(F.col("name") == c, _share(F.col("category"), targets[c])).otherwise(a), targets, F.lit(0.0))
    return sums.select("name", "category", case.alias("target"), *[(F.col(k) / F.sum(k).over(whole)).alias(k) for k in weights])


#: The mixture of the registered query and of the pipeline.
TARGETS: Targets = {
    "source": {"src0": 0.20, REST: 0.80},
    "lang": {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.09, REST: 0.01},
    "topic": {"table": 0.03, "markup": 0.03, "figures": 0.12, REST: 0.82},
}


def topic(text: Column) -> Column:
    """A coarse topic from the text's form."""
    return F.when(text.contains("|"), "table").when(text.rlike("[#$%&*]"), "markup").when(text.rlike("[0-9]"), "figures").otherwise("prose")


def sql(targets: Targets = TARGETS, rounds: int = ROUNDS, seed: int = 7) -> str:
    """The same in DuckDB SQL (cells as lists, one recursion step for each marginal)."""
    names = list(targets)

    def cat(c: str) -> str:
        named = ", ".join(f"'{k}'" for k in targets[c] if k != REST)
        return f"CASE WHEN {c} IN ({named}) THEN {c} ELSE '{REST}' END AS {c}__"

    def share(c: str) -> str:
        return f"CASE {c}__ " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in targets[c].items() if k != REST) + f" ELSE {float(targets[c].get(REST, 0.0))!r}::DOUBLE END"

    order = ", ".join(f"{c}__" for c in names)
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
    CASE WHEN text LIKE '%|%' THEN 'table' WHEN regexp_matches(text, '[#$%&*]') THEN 'markup' WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic
  FROM documents),
r AS (SELECT doc_id, topic, n_tokens, {", ".join(cat(c) for c in names)} FROM d),
cells AS (SELECT {order}, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0),
one AS (SELECT [{", ".join(f"list({c}__ ORDER BY {order})" for c in names)}] AS cats, [{", ".join(f"list({share(c)} ORDER BY {order})" for c in names)}] AS shares,
  list(tokens ORDER BY {order}) AS tokens FROM cells),
ipf AS (
  SELECT 0 AS k, tokens AS w, 0 AS calm FROM one
  UNION ALL
  SELECT k + 1, v, CASE WHEN list_bool_or(list_transform(range(1, len(w) + 1), lambda i: abs(v[i] - w[i]) > {SETTLED!r}::DOUBLE * w[i])) THEN 0 ELSE calm + 1 END FROM (
    SELECT k, calm, w, list_transform(range(1, len(w) + 1), lambda i: w[i] * shares[k % {len(names)} + 1][i] / list_sum(list_transform(range(1, len(w) + 1),
      lambda j: CASE WHEN cats[k % {len(names)} + 1][j] = cats[k % {len(names)} + 1][i] THEN w[j] ELSE 0.0 END))) AS v
    FROM ipf, one WHERE k < {rounds * len(names)} AND calm < {len(names)})),
last AS (SELECT arg_max(w, k) AS w FROM ipf),
raked AS (SELECT {", ".join(f"cats[{i + 1}][i] AS {c}__" for i, c in enumerate(names))}, w[i] * (list_sum(tokens) / list_sum(w)) / tokens[i] AS ratio FROM one, last, (SELECT unnest(range(1, len(w) + 1)) AS i FROM last)),
few AS (SELECT {order}, round(ratio, 9) AS expected FROM raked),
e AS (SELECT r.doc_id, r.topic, r.n_tokens, CASE WHEN n_tokens = 0 THEN 1.0 ELSE coalesce(few.expected, 0.0) END AS e,
        ('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM r LEFT JOIN few USING ({order}))
SELECT doc_id, topic, n_tokens, round(least(e, 1.0), 6) AS probability, u < least(e, 1.0) AS sampled, (floor(e) + (u < e - floor(e))::INT)::BIGINT AS copies FROM e
"""
