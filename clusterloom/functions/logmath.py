"""Log-factorials and what is counted with them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number: the product below 16, Stirling's series above (error under 1e-12)."""
    small = F.lit(0.0)
    total = 1
    for k in range(2, 16):
        total *= k
        small = F.when(n >= k, F.log(F.lit(float(total)))).otherwise(small)
    x = n.cast("double") + 1.0
    stirling = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3.0)) + 1 / (1260 * F.pow(x, 5.0)) - 1 / (1680 * F.pow(x, 7.0))
    return F.when(n < 16, small).otherwise(stirling)


def log_choose(n: Column, k: Column) -> Column:
    return F.when((k <= 0) | (k >= n), 0.0).otherwise(log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def log_multiset(n: Column, k: Column) -> Column:
    """ln of the number of multisets of k out of n kinds; no kinds and no picks give one."""
    return log_choose(n + k - 1, k)
