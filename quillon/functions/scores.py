"""Scoring formulas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import DIM, GRADED_CAP, RAW_SCALE, WHITE_SCALE


def z_score(hamming: Column, dim: int = DIM) -> Column:
    """Standard deviations below the distance of unrelated vectors."""
    return (F.lit(dim / 2.0) - hamming) / F.lit(math.sqrt(dim) / 2.0)


def membership(z: Column, whitened: Column, raw_scale: float = RAW_SCALE, white_scale: float = WHITE_SCALE) -> Column:
    return F.greatest(F.lit(0.0), F.least(z / raw_scale, whitened / white_scale, F.lit(1.0)))


def idf_weight(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1.0), 4.0 * F.log(n / df))


def graded_weight(n: Column, df: Column) -> Column:
    return F.least(F.lit(GRADED_CAP), F.greatest(F.lit(1), F.bround(4.0 * F.log(n / df)).cast("int")))


def angular(hamming: Column, bits: int) -> Column:
    return F.cos(F.lit(math.pi) * hamming / bits)


def tree_levels(chunks: Column, fanout: int) -> Column:
    """How often groups of `fanout` are bundled until one node is left."""
    steps = F.sequence(F.lit(1), F.lit(40))
    start = F.struct(chunks.cast("long").alias("n"), F.lit(0).alias("k"))
    step = lambda a, _: F.when(a["n"] > 1, F.struct(F.ceil(a["n"] / F.lit(fanout)).cast("long").alias("n"), (a["k"] + 1).alias("k"))).otherwise(a)
    return F.aggregate(steps, start, step, lambda a: a["k"])


def eta(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def effective_tau(own: Column, default: float) -> Column:
    """A collection's threshold if it lies between 0 and 1, else the default."""
    return F.when((own > 0) & (own < 1), own).otherwise(F.lit(default))
