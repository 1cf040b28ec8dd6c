"""Arithmetic of panels in plain floats, for answer keys that are compared to the last bit."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what a decision is worth at least.
LEAST_WORTH = 2.0**-52


def preference(values: list[float], weights: list[float]) -> float:
    """A faction's stand on an issue: the weighted mean of its values."""
    scale = sum(map(abs, weights))
    return sum(v * w for v, w in zip(values, weights, strict=True)) / scale if scale else 0.0


def tradeoff(preferences: list[float]) -> float:
    """What a decision is worth: four times the squared product of the root mean square and half the range."""
    strength = math.sqrt(sum(p * p for p in preferences) / len(preferences))
    spread = (max(preferences) - min(preferences)) / 2
    return min(1.0, max(LEAST_WORTH, 4 * (strength * spread) ** 2))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def worths(values: pd.Series, weights: pd.Series) -> pd.Series:
    """The worth of each issue: `values` has a list of numbers for each faction, `weights` one for each issue."""

    def row(factions, issues) -> list[float | None]:
        out = []
        for w in issues:
            try:
                out.append(tradeoff([preference(list(map(float, f)), list(map(float, w))) for f in factions]))
            except (TypeError, ValueError, OverflowError):
                out.append(None)
        return out

    return pd.Series([row(f, i) if f is not None and i is not None else None for f, i in zip(values, weights, strict=True)])
