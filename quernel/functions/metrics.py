"""Metrics and loss formulas as Columns over given nats, logits and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    """Summed nats as bits over bytes, at least one byte."""
    return nats / LN2 / F.greatest(n_bytes, F.lit(1))


def perplexity(nats: Column, n: Column) -> Column:
    """exp of the mean nats, over at least one token."""
    return F.exp(nats / F.greatest(n, F.lit(1)))


def log_sum_exp(logits: Column) -> Column:
    """ln of the summed exponentials, shifted by the largest logit."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Nats of the target under a softmax of the logits; ``target`` counts from 0."""
    return log_sum_exp(logits) - F.element_at(logits, (target + 1).cast("int"))


def softmax(logits: Column) -> Column:
    """The probabilities of the logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))
    return F.transform(logits, lambda z: F.exp(z - top) / total)


def focal(ce: Column, gamma: float = 2.0) -> Column:
    """(1 - p)^gamma * ce with p = exp(-ce)."""
    return F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def switch_weighted(ce: Column, is_switch: Column, weight: float = 50.0) -> Column:
    """ce, weighted where the target is a switch; divided by the count, not by the weights."""
    return ce * F.when(is_switch, F.lit(weight)).otherwise(F.lit(1.0))


def uncertainty_weighted(loss: Column, sigma: Column) -> Column:
    """loss / (2 sigma^2) + ln sigma."""
    return loss / (2 * sigma * sigma) + F.log(sigma)


def confidence_bce(confidence: Column, correct: Column, eps: float = 1e-7) -> Column:
    """Binary cross entropy of a confidence against correctness."""
    p = F.least(F.greatest(confidence, F.lit(eps)), F.lit(1 - eps))
    return -F.when(correct, F.log(p)).otherwise(F.log(1 - p))


def margin(logits: Column, target: Column, gap: float = 0.5, competitors: int = 8) -> Column:
    """max(0, gap - target's logit + the best of the largest competing logits)."""
    own = F.element_at(logits, (target + 1).cast("int"))
    others = F.filter(logits, lambda z, i: i != target)
    hardest = F.array_max(F.slice(F.sort_array(others, asc=False), 1, competitors))
    return F.greatest(F.lit(0.0), F.lit(gap) - own + hardest)


def warm_cosine(step: Column, warm: int, total: int) -> Column:
    """Linear warm-up to 1, then half a cosine down to 0."""
    return F.when(step < warm, step / warm).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), (step - warm) / (total - warm)))))


def ramp(step: Column, over: int = 10_000) -> Column:
    """min(1, step / over)."""
    return F.least(F.lit(1.0), step / over)


def calibration_bin(confidence: Column, bins: int = 10) -> Column:
    """The equal-width bin of a confidence."""
    return F.floor(F.least(confidence, F.lit(0.9999)) * bins).cast("long")
