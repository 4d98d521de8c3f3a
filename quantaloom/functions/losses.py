"""Losses of a linear score and their negative gradients by the score, as Column expressions; labels are -1 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of at most this size count as zero.
EPS = 1e-8
#: Beyond this margin the logistic loss is replaced by its asymptote.
TAIL = 18.0


def log_loss(score: Column, y: Column) -> Column:
    z = score * y
    return F.when(z > TAIL, F.exp(-z)).when(z < -TAIL, -z).otherwise(F.log(F.exp(-z) + 1))


def log_pull(score: Column, y: Column) -> Column:
    z = score * y
    return F.when(z > TAIL, y * F.exp(-z)).when(z < -TAIL, y).otherwise(y / (F.exp(z) + 1))


def hinge_loss(score: Column, y: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - score * y)


def hinge_pull(score: Column, y: Column) -> Column:
    """At a margin of exactly 1 the label still pulls."""
    return F.when(score * y <= 1, y).otherwise(F.lit(0.0))


def square_loss(score: Column, y: Column) -> Column:
    return 0.5 * (score - y) * (score - y)


def square_pull(score: Column, y: Column) -> Column:
    return y - score


LOSSES = {"logistic": (log_loss, log_pull), "hinge": (hinge_loss, hinge_pull), "square": (square_loss, square_pull)}


# ---------------------------------------------------------------- penalties and steps of one weight

def l1_value(w: Column, strength: float) -> Column:
    """The penalty of all weights: an aggregate over their rows."""
    return strength * F.sum(F.abs(w))


def l2_value(w: Column, strength: float) -> Column:
    return strength * F.sqrt(F.sum(w * w))


def l2_pull(w: Column, strength: float) -> Column:
    return strength * w


def truncated(w: Column, alpha: float) -> Column:
    """The weight pulled towards zero by alpha, stopping there."""
    return F.signum(w) * F.greatest(F.lit(0.0), F.abs(w) - alpha)


def sgd_rate(rate: float, decay: float, epoch: int) -> float:
    return rate / (1 + decay * epoch) ** 0.5


def sgd_step(w: Column, g: Column, rate: float, decay: float, epoch: int) -> Column:
    return w - sgd_rate(rate, decay, epoch) * g
