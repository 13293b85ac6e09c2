"""Logarithms of gamma functions as column expressions, which stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series with five corrections, below 10 after ten shifts."""
    x = x.cast("double")

    def series(y: Column) -> Column:
        z = 1.0 / (y * y)
        tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + tail

    shift = reduce(lambda a, i: a * (x + i), range(1, 10), x)
    return F.when(x < 10, series(x + 10) - F.ln(shift)).otherwise(series(x))


def lgamma2(x: Column) -> Column:
    """log2 Gamma(x)."""
    return lgamma(x) / math.log(2)


def log_gamma_change(count: Column, added: Column, most: int = 9) -> Column:
    """Sum of log2(count + i) for i below ``added``, which is ``most`` at most."""
    terms = [F.when(added > i, F.log2(count + float(i))).otherwise(F.lit(0.0)) for i in range(most)]
    return reduce(lambda a, b: a + b, terms)
