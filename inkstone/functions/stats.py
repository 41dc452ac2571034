"""Evaluation statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959964


def wilson(count: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a rate, to 4 places; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = count.cast("double") / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    radius = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n.isNotNull(), F.round(F.greatest(F.lit(0.0), middle - radius), 4)), F.when(n.isNotNull(), F.round(F.least(F.lit(1.0), middle + radius), 4))


def mcnemar(wins: Column, losses: Column) -> Column:
    """Exact two-sided p of a paired comparison; the binomial sum is folded in doubles, so n may pass 20."""
    n, m = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), m), start, lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return F.least(F.lit(1.0), 2 * tail)


def sign_flip(deltas: Column) -> Column:
    """Share of the sign patterns of non-zero deltas whose total is at least as far from 0 as theirs; 1 if there are none.

    All 2^m patterns are enumerated, so it is meant for a dozen or so topics.
    """
    active = F.filter(deltas, lambda x: x != 0)
    observed = F.abs(F.aggregate(active, F.lit(0).cast("long"), lambda a, x: a + x))
    patterns = F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), F.size(active)).cast("bigint") - 1)

    def total(pattern: Column) -> Column:
        up = lambda i: F.pmod(F.floor(pattern / F.pow(F.lit(2.0), i)), F.lit(2)) == 1
        signed = F.transform(active, lambda x, i: F.when(up(i), x).otherwise(-x))
        return F.abs(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x))

    return F.size(F.filter(patterns, lambda p: total(p) >= observed)) / F.size(patterns)
