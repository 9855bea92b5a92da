"""Score formulas as column expressions. Doubles throughout; the order of factors is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the chunk score and of its layers.
WEIGHTS = {"bm25": 0.7, "heading": 0.3, "scope": 0.7, "mention": 0.8}
SPECIFICITY = {"symbol": 1.4, "feature": 1.2, "module": 1.1, "project": 1.0, "company": 0.9}


def position_decay(index: Column, count: Column) -> Column:
    return F.when(count <= 1, F.lit(1.0)).otherwise(1.0 - 0.15 * (index - 1) / F.greatest(F.lit(1), count - 1))


def final_score(bm25: Column, heading=None, scope=None, mention=None, factor=None, chunk_count=None) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    heading = zero if heading is None else heading
    lexical = WEIGHTS["bm25"] * bm25 + WEIGHTS["heading"] * heading
    out = lexical * (one + WEIGHTS["scope"] * (zero if scope is None else scope)) * (one + WEIGHTS["mention"] * (zero if mention is None else mention))
    out = out * (one if factor is None else factor)
    return out if chunk_count is None else out * F.when(chunk_count > 15, F.lit(0.85)).otherwise(one)


def rounded(x: Column, places: int) -> Column:
    """x to places digits as SQL over doubles has it: the scaled value goes to the nearest whole number, halves away from zero.

    F.round goes by the decimal digits that a double is printed with, and so differs where the scaled value comes to a half or just misses it.
    """
    scale = 10.0**places
    size = F.abs(x) * scale
    whole = F.floor(size).cast("double")
    near = F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole) / scale
    return F.when(x < 0, -near).otherwise(near)


def packing_score(score: Column, tokens: Column) -> Column:
    return score / F.sqrt(F.greatest(tokens, F.lit(1)).cast("double"))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of a rate; 0 and 1 for no trials."""
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total.cast("double"))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = total == 0
    return F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(none, F.lit(1.0)).otherwise(F.least(F.lit(1.0), middle + half))
