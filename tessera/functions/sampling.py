"""Probabilities from scores, and the acceptance of guessed tokens, as array expressions.

Random numbers are columns, so that a result can be had again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: Column) -> Column:
    """Shares of the exponents; the largest score is taken off first."""
    raised = _with(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp((s - top).cast("double"))))
    return _with(raised, lambda e: _with(_total(e), lambda t: F.transform(e, lambda x: x / t)))


def nucleus(shares: Column, top_p: float) -> Column:
    """The largest shares that sum to at most ``top_p`` (ties: the first), scaled to one; all, if even the largest is more."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(a: Column, o: Column) -> Column:
        grown = a["sum"] - o["x"]
        return F.struct(grown.alias("sum"), (a["n"] + F.when(grown <= top_p, 1).otherwise(0)).alias("n"))

    order = F.array_sort(F.transform(shares, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    kept = _with(order, lambda o: F.slice(o, F.lit(1), F.aggregate(o, start, step, lambda a: a["n"])))
    edge = lambda k: F.struct((-_total(F.transform(k, lambda o: o["x"]))).alias("sum"), F.element_at(k, -1).alias("last"))
    cut = lambda e: F.transform(shares, lambda x, i: F.when(F.struct((-x).alias("x"), i.alias("i")) <= e["last"], x / e["sum"]).otherwise(F.lit(0.0)))
    return _with(kept, lambda k: F.when(F.size(k) > 0, _with(F.when(F.size(k) > 0, edge(k)), cut)).otherwise(shares))


def probabilities(scores: Column, temperature: float = 0.0, top_p: float = 1.0) -> Column:
    """What a token is drawn by: all on the first best score at temperature zero, else shares, cut to a nucleus."""
    if temperature < 0 or not 0 < top_p <= 1:
        raise ValueError("temperature must not be negative, and top_p must be over 0 and at most 1")
    if temperature <= 1e-6:
        best = F.array_position(scores, F.array_max(scores)) - 1
        return _with(best, lambda b: F.transform(scores, lambda _, i: F.when(i == b, 1.0).otherwise(0.0)))
    shares = softmax(F.transform(scores, lambda s: s / F.lit(temperature)))
    return shares if top_p == 1 else _with(shares, lambda p: nucleus(p, top_p))


def draw(shares: Column, uniform: Column) -> Column:
    """The first position up to which the shares sum to over ``uniform`` (else the last one of any share)."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("found"), F.lit(-1).alias("last"))

    def step(a: Column, x: Column) -> Column:
        grown = a["sum"] + x
        found = F.when((a["found"] < 0) & (x > 0) & (grown > uniform), a["i"]).otherwise(a["found"])
        return F.struct(grown.alias("sum"), (a["i"] + 1).alias("i"), found.alias("found"), F.when(x > 0, a["i"]).otherwise(a["last"]).alias("last"))

    return F.aggregate(shares, start, step, lambda a: F.when(a["found"] >= 0, a["found"]).otherwise(a["last"]))


def accepted(target: Column, draft: Column, uniforms: Column) -> Column:
    """How many guesses stand: up to the first whose uniform number is over its target share / draft share."""
    rows = F.arrays_zip(target.alias("t"), draft.alias("d"), uniforms.alias("u"))
    refused = F.array_position(F.transform(rows, lambda r: r["u"] * r["d"] > r["t"]), True).cast("int")
    return F.when(refused > 0, refused - 1).otherwise(F.size(target))


def left_over(target: Column, draft: Column) -> Column:
    """What the target has above the draft, scaled to one (the target, if it has nothing)."""
    above = F.transform(F.arrays_zip(target.alias("t"), draft.alias("d")), lambda r: F.greatest(r["t"] - r["d"], F.lit(0.0)))
    return _with(above, lambda a: _with(_total(a), lambda s: F.when(s > 0, F.transform(a, lambda x: x / s)).otherwise(target)))


def speculate(guesses: Column, target: Column, draft: Column, uniforms: Column) -> Column:
    """Tokens of one round: the guesses that stand, and one that the target model draws.

    ``target`` has one row of shares more than there are guesses, ``draft`` one
    for each; the last of ``uniforms`` is for the token that is drawn.
    """
    at = lambda rows: F.transform(guesses, lambda g, i: F.get(F.get(rows, i), g))
    n = accepted(at(target), at(draft), F.slice(uniforms, F.lit(1), F.size(guesses)))

    def tokens(k: Column) -> Column:
        shares = F.when(k < F.size(guesses), left_over(F.get(target, k), F.get(draft, k))).otherwise(F.get(target, k))
        return F.concat(F.slice(guesses, F.lit(1), k), F.array(draw(shares, F.get(uniforms, F.size(guesses)))))

    return _with(n, tokens)


def settings(temperature: float, top_p: float, max_tokens: int, eos: int, stops: Sequence[int] = (), n: int = 1) -> dict:
    """What a serving engine is asked for; the temperature is never quite zero."""
    return {"n": n, "temperature": temperature + 1e-6, "top_p": top_p, "max_tokens": max_tokens, "stop_token_ids": [eos, *stops]}
