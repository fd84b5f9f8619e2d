"""Pairwise measures as column expressions over one pair row.

A pair row has, for query q and reference r with non-negative profiles: ``inter`` (shared
dimensions), ``eq`` (shared dimensions with one value), ``dot``, ``mn`` (sum of minima), ``bh``
(sum of square roots of products of row-normalised weights) and per side ``sup``, ``act`` and
``sq`` (support, sum, sum of squares) with the suffixes _q and _r. Zero denominators follow the
measure: empty profiles have discrepancy 0 and affinity 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def pathsim() -> Column:
    return clip(ratio(2.0 * c("dot"), c("sq_q") + c("sq_r")))


def pathsim_forced() -> Column:
    """The early variant: an entity resembles itself fully, even without any link."""
    return F.when(c("q") == c("r"), 1.0).otherwise(pathsim())


def cosine() -> Column:
    return clip(ratio(c("dot"), F.sqrt("sq_q") * F.sqrt("sq_r")))


def jaccard() -> Column:
    union = c("sup_q") + c("sup_r") - c("inter")
    return ratio((union - c("inter")).cast("double"), union.cast("double"))


def l1() -> Column:
    return c("act_q") + c("act_r") - 2.0 * c("mn")


def bray_curtis() -> Column:
    return ratio(l1(), c("act_q") + c("act_r"))


def value_hamming() -> Column:
    return c("sup_q") + c("sup_r") - c("inter") - c("eq")


def support_hamming() -> Column:
    return c("sup_q") + c("sup_r") - 2 * c("inter")


def global_affinity(hamming: Column, distance: Column, b0: Column, b1: Column, alpha: Column) -> Column:
    return clip(1.0 - (alpha * hamming / b0 + (1.0 - alpha) * distance / b1))


def relative_affinity(j: Column, bc: Column, beta: Column) -> Column:
    return clip(1.0 - (beta * j + (1.0 - beta) * bc))


def adaptive_affinity(j: Column, bc: Column, beta: Column) -> Column:
    return clip(1.0 - (bc + beta * F.greatest(j - bc, F.lit(0.0))))


def tri_component(j: Column, bc: Column, cos: Column, w0: Column, w1: Column, w2: Column) -> Column:
    return w0 * (1.0 - j) + w1 * (1.0 - bc) + w2 * cos


def current_distance(lam: Column) -> Column:
    """Rank-only: value-Hamming and L1, not normalised; smaller is nearer."""
    return lam * value_hamming() + (1.0 - lam) * l1()


def historical_distance(lam: Column) -> Column:
    """The current distance over a range term (``rng``); infinitely far where that is zero."""
    return F.coalesce(F.try_divide(current_distance(lam), lam + (1.0 - lam) * c("rng")), F.lit(float("inf")))


def dimension_affinity(dims: Column, span: Column, alpha: Column) -> Column:
    """Global affinity with value-Hamming, the number of dimensions as its bound, and a value span that counts implicit zeros."""
    return clip(1.0 - (alpha * value_hamming() / dims + (1.0 - alpha) * l1() / (dims * span)))


def hetesim_forced() -> Column:
    """The early variant over row-normalised halves: the diagonal is 1."""
    return F.when(c("q") == c("r"), 1.0).otherwise(cosine())


def lambda_of_alpha(alpha: Column, b0: Column, b1: Column) -> Column:
    inner = ratio(alpha * b1, b0 * (1.0 - alpha) + alpha * b1)
    return F.when(alpha <= 0, 0.0).when(alpha >= 1, 1.0).otherwise(inner)


def alpha_of_lambda(lam: Column, b0: Column, b1: Column) -> Column:
    inner = ratio(lam * b0, b1 * (1.0 - lam) + lam * b0)
    return F.when(lam <= 0, 0.0).when(lam >= 1, 1.0).otherwise(inner)
