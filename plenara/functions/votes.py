"""Column functions over votes: tests, counts, entropies, losses. Votes are 1 agree, -1 disagree, 0 pass, null unseen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = {"agree": 1, "disagree": -1, "pass": 0}
UNIFORM_BRIER = 1 / 3


def prop_test(successes: Column, trials: Column) -> Column:
    """z of a proportion against one half, with one pseudo-success; 1 where there were no trials."""
    n = (trials + 1).cast("double")
    return 2 * F.sqrt(n) * ((successes + 1) / n - F.lit(0.5))


def two_prop_test(hits_a: Column, hits_b: Column, trials_a: Column, trials_b: Column) -> Column:
    """z of the difference of two proportions, one added to all four counts; 0 where the pooled rate is 1."""
    a, b, n, m = ((c + 1).cast("double") for c in (hits_a, hits_b, trials_a, trials_b))
    pooled = (a + b) / (n + m)
    return F.when(pooled == 1, F.lit(0.0)).otherwise((a / n - b / m) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)))


def rating_to_vote(rating: Column) -> Column:
    """A rating of 0 to 10 as a vote of -1 to 1; anything else, NaN too, is 0."""
    r = rating.cast("double")
    return F.when(r.isNull() | F.isnan(r) | (r < 0) | (r > 10), F.lit(0.0)).otherwise((2 * (r - 5)) / 10)


def laplace(count: Column, seen: Column) -> Column:
    return (count + 1) / (seen + 2).cast("double")


def class_counts(vote: Column) -> tuple[Column, Column, Column]:
    """Aggregates: how many agree, disagree and pass."""
    return tuple(F.count_if(vote == v).alias(k) for k, v in LABELS.items())


def entropy(*counts: Column) -> Column:
    """Normalised entropy of class counts, from 0 to 1; 0 of nothing."""
    total = _sum(counts).cast("double")
    terms = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return F.when(total > 0, _sum(terms) / math.log(3)).otherwise(F.lit(0.0))


def separation(*counts: Column) -> Column:
    """Share of unordered pairs of votes that differ: what the equal pairs leave. 0 of fewer than two votes."""
    n = _sum(counts)
    equal = _sum([c * (c - 1) for c in counts])
    return F.when(n > 1, 1 - equal / (n * (n - 1)).cast("double")).otherwise(F.lit(0.0))


def argmax_vote(agree: Column, disagree: Column, passed: Column) -> Column:
    """The likeliest vote; of equal ones agree, then pass, then disagree."""
    pair = lambda p, v: F.struct(p.cast("double").alias("p"), F.lit(v).alias("v"))
    return F.array_max(F.array(pair(agree, 1), pair(disagree, -1), pair(passed, 0)))["v"]


def brier(agree: Column, disagree: Column, passed: Column, vote: Column) -> Column:
    """Half the squared distance of a distribution from the vote: 0 to 1, a third for the uniform one."""
    part = lambda p, v: F.pow(p - F.when(vote == v, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(2.0))
    return (part(agree, 1) + part(disagree, -1) + part(passed, 0)) / 2


def skill(loss: Column, reference: Column) -> Column:
    """1 - loss / reference, 0 without a positive reference; what is below 1e-15 is 0."""
    s = F.when(reference > 0, 1 - loss / reference).otherwise(F.lit(0.0))
    return F.when(F.abs(s) < 1e-15, F.lit(0.0)).otherwise(s)


def vote_symbol(vote: Column) -> Column:
    return F.coalesce(vote.cast("string"), F.lit("?"))


def lenient_probabilities(prediction: Column) -> Column:
    """A map of label (or vote as text) to number as struct (agree, disagree, pass) that sums to 1.

    Unknown keys are ignored and missing labels are 0; a map without a positive, finite total,
    or with a negative or non-finite number under a label, is uniform, as is a null.
    """
    def of(label: str, vote: int) -> Column:
        return F.coalesce(prediction[label], prediction[str(vote)], F.lit(0.0)).cast("double")

    parts = {k: of(k, v) for k, v in LABELS.items()}
    total = _sum(list(parts.values()))
    ok = prediction.isNotNull() & (total > 0) & (total < float("inf"))
    for p in parts.values():
        ok = ok & ~F.isnan(p) & (p >= 0)
    return F.struct(*[F.when(ok, p / total).otherwise(F.lit(1 / 3)).alias(k) for k, p in parts.items()])


def one_hot(vote: Column) -> Column:
    """A point prediction as a distribution; uniform if it is no vote."""
    known = vote.isin(-1, 0, 1)
    return F.struct(*[F.when(known, (vote == v).cast("double")).otherwise(F.lit(1 / 3)).alias(k) for k, v in LABELS.items()])


def _sum(columns) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out
