"""Model-free forecasts of hidden votes, and their scores.

A forecast is (baseline, session, p, s, pa, pd, pp) with one row for each hidden cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenara.functions import votes as V
from plenara.operators import matrix as M

NEIGHBORS, SMOOTHING, LEAST_WEIGHT = 5, 0.5, 1e-6
_OUT = ["session", "p", "s", "pa", "pd", "pp"]


def uniform(hidden: DataFrame) -> DataFrame:
    third = F.lit(1 / 3)
    return hidden.select("session", "p", "s", third.alias("pa"), third.alias("pd"), third.alias("pp"))


def prior(hidden: DataFrame, train: DataFrame) -> DataFrame:
    """The class shares of `train`, whose cells include held-out ones: one row, broadcast."""
    return hidden.select("session", "p", "s").crossJoin(F.broadcast(M.class_prior(train)))


def column_frequency(hidden: DataFrame, visible: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """The class shares of each cell's statement among visible votes; uniform where there are none."""
    shares = M.class_prior(visible, "session", "s", smoothing=smoothing)
    met = hidden.select("session", "p", "s").join(shares, ["session", "s"], "left")
    return met.select("session", "p", "s", *[F.coalesce(c, F.lit(1 / 3)).alias(c) for c in ("pa", "pd", "pp")])


def ranked_neighbors(hidden: DataFrame, visible: DataFrame) -> DataFrame:
    """(session, p, s, q, vote, similarity, matches, joint, rank): who else voted on a hidden cell's statement, most alike first.

    Only participants with a hidden cell enter the self-join's left side, so that its size is
    the hidden cells' times the voters of their statements, not the square of a session.
    """
    seen = visible.where(F.col("vote").isin(-1, 0, 1))
    targets = hidden.select("session", "p", "s")
    others = targets.join(seen.select("session", "s", F.col("p").alias("q"), "vote"), ["session", "s"]).where("q <> p")
    mine = targets.join(seen.select("session", "p", F.col("s").alias("t"), F.col("vote").alias("mine")), ["session", "p"]).where("t <> s")
    theirs = seen.select("session", F.col("p").alias("q"), F.col("s").alias("t"), F.col("vote").alias("theirs"))
    pairs = mine.join(theirs, ["session", "t"]).where("q <> p")
    alike = pairs.groupBy("session", "p", "s", "q").agg(F.count_if(F.col("mine") == F.col("theirs")).alias("matches"), F.count("*").alias("joint"))
    met = others.join(alike, ["session", "p", "s", "q"]).withColumn("similarity", F.col("matches") / F.col("joint"))
    order = Window.partitionBy("session", "p", "s").orderBy(F.desc("similarity"), F.desc("matches"), "q", F.desc("vote"))
    return met.withColumn("rank", F.row_number().over(order))


def nearest_participants(hidden: DataFrame, visible: DataFrame, neighbors: int = NEIGHBORS, smoothing: float = SMOOTHING) -> DataFrame:
    """Smoothed class weights of the nearest participants, each weighing its similarity; the statement's shares where there is none."""
    if not isinstance(neighbors, int) or isinstance(neighbors, bool) or neighbors <= 0:
        raise ValueError("neighbors must be a positive integer")
    if isinstance(smoothing, bool) or not 0 <= smoothing < float("inf"):
        raise ValueError("smoothing must be finite and not negative")
    near = ranked_neighbors(hidden, visible).where(F.col("rank") <= neighbors)
    weight = F.greatest("similarity", F.lit(LEAST_WEIGHT))
    sums = near.groupBy("session", "p", "s").agg(*[(F.sum(F.when(F.col("vote") == v, weight).otherwise(F.lit(0.0))) + smoothing).alias(k) for k, v in V.LABELS.items()])
    total = F.col("agree") + F.col("disagree") + F.col("pass")
    own = sums.select("session", "p", "s", (F.col("agree") / total).alias("ka"), (F.col("disagree") / total).alias("kd"), (F.col("pass") / total).alias("kp"))
    back = column_frequency(hidden, visible, smoothing)
    return back.join(own, ["session", "p", "s"], "left").select("session", "p", "s", F.coalesce("ka", "pa").alias("pa"), F.coalesce("kd", "pd").alias("pd"), F.coalesce("kp", "pp").alias("pp"))


def baselines(hidden: DataFrame, visible: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """All comparators as one forecast table."""
    made = {"uniform": uniform(hidden)}
    if train is not None:
        made["prior"] = prior(hidden, train)
    made["column"] = column_frequency(hidden, visible)
    made["neighbors"] = nearest_participants(hidden, visible)
    out = None
    for name, forecast in made.items():
        part = forecast.select(F.lit(name).alias("baseline"), *_OUT)
        out = part if out is None else out.unionByName(part)
    return out


def cell_scores(forecast: DataFrame, hidden: DataFrame) -> DataFrame:
    """Each hidden cell with its loss and hit under each forecast; a missing forecast is uniform and misses."""
    truth = hidden.select("session", "p", "s", "vote")
    names = forecast.select("baseline").distinct()
    every = truth.crossJoin(F.broadcast(names)).join(forecast, ["baseline", "session", "p", "s"], "left")
    third = lambda c: F.coalesce(c, F.lit(1 / 3))
    p = third(F.col("pa")), third(F.col("pd")), third(F.col("pp"))
    hit = F.coalesce(V.argmax_vote(F.col("pa"), F.col("pd"), F.col("pp")) == F.col("vote"), F.lit(False)) & F.col("pa").isNotNull()
    return every.select("baseline", "session", "p", "s", "vote", V.brier(*p, F.col("vote")).alias("brier"), hit.cast("double").alias("hit"))


def scores(forecast: DataFrame, hidden: DataFrame) -> DataFrame:
    """Accuracy, reward, loss and skill of each baseline, averaged over cells; skill against uniform, and against the prior if it is there."""
    means = cell_scores(forecast, hidden).groupBy("baseline").agg(F.count("*").alias("n"), F.avg("hit").alias("vote_accuracy"), F.avg("brier").alias("brier"))
    prior_loss = means.where("baseline = 'prior'").agg(F.max("brier").alias("prior_brier"))
    met = means.crossJoin(F.broadcast(prior_loss))
    return met.select(
        "baseline", "n", "vote_accuracy", (1 - F.col("brier")).alias("probability_reward"), "brier",
        V.skill(F.col("brier"), F.lit(V.UNIFORM_BRIER)).alias("brier_skill_vs_uniform"),
        F.when(F.col("prior_brier").isNotNull(), V.skill(F.col("brier"), F.col("prior_brier"))).alias("brier_skill_vs_prior"),
    )
