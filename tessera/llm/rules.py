"""Quality rules: a learned decision list over text statistics, all in DataFrame expressions.

Sequential covering: a rule is a conjunction of thresholds, grown by FOIL gain on
two thirds of a labelled sample and pruned on the rest.  It joins the list if it
is precise on all rows that are left, by share and by Laplace's estimate (which a
handful of rows can't reach); those that it covers leave before the next one is
grown.  Otherwise its first condition begins no rule until one has been found.
The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import lowest, materialize, once

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MAX_ROWS = 6000
BINS = 12
MAX_RULES = 6
MAX_CONDITIONS = 3
#: Least share of bad rows among those that a rule covers, as counted and by Laplace's estimate.
PRECISION, LAPLACE = 0.95, 0.9
MAX_FAILURES = 8
MIN_COVER = 5
ALIKE = 0.95

#: Learned from: each is a whole number, so thresholds are exact on any engine.
FEATURES = ("n_words", "symbol_permille", "dup_line_permille", "repeat_permille", "chars_per_100_words", "upper_permille", "exclaim_permille", "digit_permille")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.at_least else F.col(self.feature) < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value}"


Rule = tuple[Condition, ...]


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole-text statistics of every row: the base counts and the learned-from ratios.

    A null text counts as empty: no words, and all ratios 0.  Rows are judged one
    by one, so repeats and ties do not matter; other columns are dropped.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(f"[^{BLANKS}]+"), F.lit(0))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    one = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), words.alias("words"), lines.alias("lines"))

    def gram(w: Column, i: Column) -> Column:
        b, c = F.get("words", i + 1), F.get("words", i + 2)
        return F.struct(F.xxhash64(w, b, c).alias("h"), F.hash(w, b, c).alias("g"), i.alias("i"))

    grams = F.sort_array(F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), gram))
    two = one.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("body"), BLANKS).cast("long").alias("word_chars"),
        (F.length("body") - _without(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("body") - _without(F.col("body"), "!")).cast("long").alias("n_exclaims"),
        (F.length("body") - _without(F.col("body"), "0123456789")).cast("long").alias("n_digits"),
        (F.length("body") - _without(F.col("body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_uppers"),
        once(grams).alias("grams"),
    )
    same = lambda x, y: y.isNotNull() & (x["h"] == y["h"]) & (x["g"] == y["g"])

    def repeated(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("grams", k - 1))
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, F.get("grams", k + 1)), F.lit(False))

    starts = F.sort_array(F.transform(F.filter("grams", repeated), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n")),
        lambda s: s["n"].cast("long"),
    )
    three = two.withColumn("n_repeat_words", once(covered)).drop("grams")
    per = lambda a, b, k=1000: F.when(F.col(b) > 0, F.floor(F.col(a) * k / F.col(b))).otherwise(0).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return three.withColumns(
        {
            "symbol_permille": per("n_symbols", "n_words"),
            "dup_line_permille": per("n_dup_lines", "n_lines"),
            "repeat_permille": per("n_repeat_words", "n_words"),
            "chars_per_100_words": per("word_chars", "n_words", 100),
            "upper_permille": per("n_uppers", "word_chars"),
            "exclaim_permille": per("n_exclaims", "n_words"),
            "digit_permille": per("n_digits", "word_chars"),
            "base_failed": failed,
        }
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Statistics of at most ``max_rows`` labelled documents in hash order, with ``bad`` and ``prune``.

    The bound is on the labelled rows that are learned from, whatever the size of
    the tables; labels without a verdict are ignored.  Rows that fail the base
    checks need no rule and are left out.
    """
    bad = F.col("quality") == 0 if target is None else target
    known = labels.select(F.col(doc_id).alias("labelled"), bad.alias("bad")).where("bad is not null and labelled is not null")
    few = materialize(lowest(known.groupBy("labelled").agg(F.max("bad").alias("bad")), "labelled", max_rows), "labels")
    rows = docs.join(F.broadcast(few), F.col(doc_id) == F.col("labelled"), "left_semi")
    stats = statistics(rows, doc_id, text).where(~F.col("base_failed")).join(F.broadcast(few), F.col("doc_id") == F.col("labelled"))
    return materialize(stats.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0).alias("prune"), *FEATURES), "sample")


def _counts(rows: DataFrame, marks: dict[str, list[int]]) -> dict[tuple[str, int], tuple[int, int]]:
    """Bad and good rows by feature and bin; as many results as there are bins."""
    bins = [F.struct(F.lit(f).alias("feature"), sum(((F.col(f) >= v).cast("int") for v in marks[f]), F.lit(0)).alias("bin")) for f in marks if marks[f]]
    if not bins:
        return {}
    one = rows.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n"))
    return {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in one.collect()}


def _both(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _grow(rows: DataFrame, marks: dict[str, list[int]], max_conditions: int, barred: set[Condition]) -> Rule:
    rule: list[Condition] = []
    for _ in range(max_conditions):
        counts = _counts(rows.where(_both(rule)), marks)
        if not counts:
            break
        any_feature = next(iter(counts))[0]
        p0, n0 = (sum(v[i] for (f, _), v in counts.items() if f == any_feature) for i in (0, 1))
        if not p0 or not n0:
            break
        base, gains = math.log2(p0 / (p0 + n0)), {}
        for feature, values in marks.items():
            for k, value in enumerate(values):
                for at_least in (True, False):
                    inside = [v for (f, b), v in counts.items() if f == feature and (b > k) == at_least]
                    p, n = sum(v[0] for v in inside), sum(v[1] for v in inside)
                    if p >= MIN_COVER and (rule or Condition(feature, at_least, value) not in barred):
                        gains[Condition(feature, at_least, value)] = (p * (math.log2(p / (p + n)) - base), p + n)
        best = max(gains, key=lambda c: (gains[c][0], str(c)), default=None)
        if best is None or gains[best][0] <= 1e-9:
            break
        # Of thresholds that do about as well, the strictest leaves most rows alone.
        alike = [c for c in gains if (c.feature, c.at_least) == (best.feature, best.at_least) and gains[c][0] >= ALIKE * gains[best][0]]
        rule.append(min(alike, key=lambda c: (gains[c][1], -c.value if c.at_least else c.value)))
    return tuple(rule)


def _strictest(rule: Rule) -> Rule:
    """Of conditions on one feature in one direction, only the one that implies the others."""
    last = {(c.feature, c.at_least): c for c in sorted(rule, key=lambda c: c.value if c.at_least else -c.value)}
    return tuple(c for c in dict.fromkeys(rule) if last[c.feature, c.at_least] == c)


def _covered(rows: DataFrame, parts: Sequence[Rule]) -> list[tuple[int, int]]:
    """Bad and good rows that each conjunction covers."""
    sums = [F.sum((_both(part) & side).cast("int")) for part in parts for side in (F.col("bad"), ~F.col("bad"))]
    got = [x or 0 for x in rows.agg(*sums).first()]
    return list(zip(got[::2], got[1::2]))


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The leading part of the rule with the best worth on rows it was not grown on; the longer one, where they cover the same."""
    parts = [_strictest(rule[:k]) for k in range(1, len(rule) + 1)]
    worth = [((p - n) / (p + n) if p + n else -1.0, p, k) for k, (p, n) in enumerate(_covered(rows, parts))]
    return parts[max(worth)[2]]


def thresholds(sample: DataFrame) -> dict[str, list[int]]:
    """Quantiles of all rows and of the bad ones: the values that conditions may have."""
    shares = [k / (BINS + 1) for k in range(1, BINS)] + [0.95, 0.98]
    cuts = sample.agg(*[F.percentile_approx(f, shares, 100_000).alias(f) for f in FEATURES]).first()
    bad = sample.where("bad").agg(*[F.percentile_approx(f, [0.05, 0.1, 0.25, 0.5, 0.75], 100_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set([*(cuts[f] or []), *(bad[f] or []), *(v + 1 for v in cuts[f] or [])])) for f in FEATURES}


def learn(sample: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, precision: float = PRECISION, laplace: float = LAPLACE) -> list[Rule]:
    """An ordered list of rules for bad rows; empty if there is nothing to learn from."""
    marks = thresholds(sample)
    grow, prune = sample.where(~F.col("prune")), sample.where("prune")
    rules: list[Rule] = []
    barred: set[Condition] = set()
    failures = 0
    while len(rules) < max_rules and failures < MAX_FAILURES:
        left = ~fires(rules)
        grown = _grow(grow.where(left), marks, max_conditions, barred)
        if not grown:
            break
        rule = _prune(prune.where(left), grown)
        p, n = _covered(sample.where(left), [rule])[0]
        if p and p >= precision * (p + n) and p + 1 >= laplace * (p + n + 2):
            rules.append(rule)
            barred, failures = set(), 0
        else:
            barred.add(grown[0])
            failures += 1
    return rules


def fires(rules: Sequence[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _both(rule)
    return out


def verdict(rules: Sequence[Rule]) -> Column:
    """The first rule that fires, as text; null where none does."""
    if not rules:
        return F.lit(None).cast("string")
    case = F.when(_both(rules[0]), F.lit(" and ".join(map(str, rules[0]))))
    for rule in rules[1:]:
        case = case.when(_both(rule), F.lit(" and ".join(map(str, rule))))
    return case


def judge(docs: DataFrame, rules: Sequence[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every row with ``rule`` (the rule that drops it), ``base_failed`` and ``kept``."""
    stats = statistics(docs, doc_id, text).withColumn("rule", verdict(rules))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")
