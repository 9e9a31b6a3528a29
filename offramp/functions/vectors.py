"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns, for small vectors.

These run in the JVM as higher-order functions. For vocabularies above about a thousand entries
use the Arrow versions in ``offramp.functions.kernels``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offramp.functions.columns import as_column, doubles, let


def vector_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return vector_sum(F.zip_with(a, b, lambda x, y: x * y))


def rms_norm(col: Column | str, weight: Column | None = None, eps: float = 1e-6) -> Column:
    """``weight * x / sqrt(mean(x^2) + eps)``, accumulated in double."""
    def scaled(x: Column) -> Column:
        mean_square = vector_sum(F.transform(x, lambda v: v * v)) / F.size(x)
        return let(F.lit(1.0) / F.sqrt(mean_square + F.lit(eps)),
                   lambda r: F.transform(x, lambda v: v * r))
    out = let(doubles(col), scaled)
    if weight is not None:
        out = F.zip_with(out, doubles(weight), lambda v, w: v * w)
    return out


def logsumexp(col: Column | str) -> Column:
    """``log(sum(exp(x)))`` with the maximum taken out first."""
    def of(x: Column) -> Column:
        return let(F.array_max(x), lambda m: m + F.log(
            F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))))
    return let(doubles(col), of)


def log_softmax(col: Column | str) -> Column:
    return let(doubles(col), lambda x: let(
        logsumexp(x), lambda z: F.transform(x, lambda v: v - z)))


def softmax(col: Column | str) -> Column:
    return F.transform(log_softmax(col), lambda v: F.exp(v))


def kl_divergence(teacher: Column | str, student: Column | str) -> Column:
    """``sum(p_t * (log p_t - log p_s))`` of two logit vectors of equal size.

    Terms whose teacher probability is zero add nothing. Vectors of different size fail.
    """
    def terms(pair: Column) -> Column:
        t, s = pair["t"], pair["s"]
        checked = F.when(F.size(t) == F.size(s), s).otherwise(
            F.raise_error(F.lit("teacher and student logits differ in size")).cast("array<double>"))
        return let(
            F.struct(logsumexp(t).alias("t"), logsumexp(s).alias("s")),
            lambda z: vector_sum(F.zip_with(
                t, checked,
                lambda a, b: F.when(F.exp(a - z["t"]) == 0, F.lit(0.0)).otherwise(
                    F.exp(a - z["t"]) * ((a - z["t"]) - (b - z["s"]))))))
    return let(F.struct(doubles(teacher).alias("t"), doubles(student).alias("s")), terms)


def argmax(col: Column | str) -> Column:
    """Index of the largest entry, counted from 0; the lowest index wins a tie."""
    return let(as_column(col), lambda x: F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_k(col: Column | str, k: int) -> Column:
    """The ``k`` best ``(token, logit)`` pairs, best first, lowest token first on a tie."""
    ranked = F.array_sort(F.transform(
        doubles(col), lambda v, i: F.struct((-v).alias("neg"), i.cast("int").alias("token"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(
        e["token"].alias("token"), (-e["neg"]).alias("logit")))


def at(col: Column | str, index: Column) -> Column:
    """Entry at a 0-based index; null when the index is null or outside."""
    return F.get(as_column(col), index.cast("int"))
