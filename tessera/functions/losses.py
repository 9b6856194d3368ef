"""Preference losses, rewards and reward-model metrics over log-probability columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("sigmoid", "hinge", "cross_entropy", "raft", "ipo", "kl", "tv", "hellinger", "rev_kl")


def log_sigmoid(x: Column) -> Column:
    """ln(1 / (1 + exp(-x))), without overflow on either side."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.exp(log_sigmoid(x))


def ratio_gap(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, penalty: Column | None = None, reference_free: bool = False) -> Column:
    """How much more the policy prefers the chosen answer than the reference does."""
    own = chosen - rejected
    if reference_free:
        return own
    other = ref_chosen - ref_rejected
    return own - (other if penalty is None else other + penalty)


def preference_loss(kind: str, chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, margin: Column | None = None, beta: float = 0.1, penalty: Column | None = None, reference_free: bool = False) -> Column:
    """One of the nine losses of a chosen/rejected pair."""
    gap = ratio_gap(chosen, rejected, ref_chosen, ref_rejected, penalty, reference_free)
    scaled = gap * beta
    if kind == "sigmoid":
        return -log_sigmoid(scaled)
    if kind == "hinge":
        return F.greatest(F.lit(0.0), 1 - scaled)
    if kind == "cross_entropy":
        return -log_sigmoid((chosen - ref_chosen) * beta)
    if kind == "raft":
        return -chosen
    if kind == "ipo":
        return F.pow(gap - 1 / (2 * beta), F.lit(2.0))
    if kind not in KINDS:
        raise ValueError(f"unknown loss: {kind}")
    if margin is None:
        raise ValueError(f"loss {kind} needs a margin")
    wanted = sigmoid(margin)
    if kind == "rev_kl":
        return -wanted * log_sigmoid(scaled) - (1 - wanted) * log_sigmoid(-scaled)
    p = sigmoid(scaled)
    if kind == "tv":
        return F.abs(p - wanted)
    p = F.least(p, F.lit(0.999))
    if kind == "hellinger":
        return 0.5 * (F.pow(F.sqrt(p) - F.sqrt(wanted), F.lit(2.0)) + F.pow(F.sqrt(1 - p) - F.sqrt(1 - wanted), F.lit(2.0)))
    softened = 1 / (1 + F.exp(-margin) * 1.001)
    return p * (F.ln(p) - F.ln(softened)) + (1 - p) * (F.ln(1 - p) - F.ln(1 - softened))


def rewards(logp: Column, ref_logp: Column, beta: float = 0.1) -> Column:
    return (logp - ref_logp) * beta


def length_penalised(score: Column, text: Column, penalty: float) -> Column:
    return score - F.length(text) * penalty


def pair_accuracy(positive: Column, negative: Column, ties_count: bool = False) -> Column:
    better = positive >= negative if ties_count else positive > negative
    return F.avg(better.cast("int").cast("double"))


def pair_loss(positive: Column, negative: Column) -> Column:
    return F.avg(-log_sigmoid(positive - negative))
