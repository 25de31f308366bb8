"""Row-local scalar and array functions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1e6  # of sanitised features
EPS = 1e-6  # of clamped probabilities


def is_finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sanitize(x: Column, limit: float = LIMIT) -> Column:
    """NaN and null become 0, infinities and large values the limit."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(clip(x, -limit, limit))


def sanitize_array(xs: Column, limit: float = LIMIT) -> Column:
    return F.transform(xs, lambda x: sanitize(x, limit))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def denormalize(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def block(xs: Column, start: int, width: int) -> Column:
    """A block of an array column, 1-based."""
    return F.slice(xs, start, width)


def pick(xs: Column, indices: list[int]) -> Column:
    """The elements at zero-based indices, in this order."""
    return F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(xs, i))


def masked(xs: Column, on: bool, width: int) -> Column:
    """A block, or zeros where its modality is off."""
    return xs if on else F.array_repeat(F.lit(0.0).cast("float"), width)


def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def bucket_of(text: Column, buckets: int) -> Column:
    """A stable bucket: the first eight hex digits of MD5, modulo ``buckets``."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def uniform_of(text: Column) -> Column:
    """A stable number in [0, 1) from the first 13 hex digits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
