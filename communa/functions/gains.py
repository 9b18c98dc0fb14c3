"""Column functions of the objective: gains of moves, softmax weights, seeded uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality_increment(weight_to: Column, own: Column, cluster: Column, gamma: Column | float) -> Column:
    """Gain of joining a cluster of node weight ``cluster``, for a node of weight ``own`` with edges of ``weight_to`` into it."""
    return weight_to - own * cluster * gamma


def quality_increment_paper(weight_to: Column, own: Column, cluster: Column, gamma: Column | float) -> Column:
    """The variant with the sum of both node weights."""
    return weight_to - (own + cluster) * gamma


def approximate_exponent(x: Column) -> Column:
    """(1 + x/256)^256, 0 below -256."""
    return F.when(x < -256, F.lit(0.0)).otherwise(F.pow(F.lit(1.0) + x / 256.0, F.lit(256.0)))


def log_exponent(x: Column) -> Column:
    """The logarithm of :func:`approximate_exponent`, which doesn't overflow."""
    return F.when(x < -256, F.lit(float("-inf"))).otherwise(256.0 * F.log1p(x / 256.0))


def well_connected(outside: Column, weight: Column, total: Column, gamma: Column | float) -> Column:
    """Whether a part of node weight ``weight`` has edges enough (``outside``) to the rest of its cluster of weight ``total``."""
    return outside >= weight * (total - weight) * gamma


def seeded_uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on seed and columns only, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / float(1 << 53)
