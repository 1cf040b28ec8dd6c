"""Statistics of repeated evaluation runs.

Runs are long: rollouts (keys of the run, task, rollout, reward). Resampling draws positions
from hashes of (seed, stratum, sample, position) instead of a generator's state, so any
partitioning and any engine gives the same draws, and all models of a stratum share them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenara.functions.text import hash60

RUN = ("environment", "model", "prompt_mode")


def newest_runs(runs: DataFrame, keys: tuple[str, ...] = RUN, time: str = "ts", run: str = "run_id") -> DataFrame:
    """The latest run of each key, of equal times the greatest run id; a null key is a key of its own."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(run))
    return runs.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def task_means(rollouts: DataFrame, keys: tuple[str, ...], task: str = "task", value: str = "reward") -> DataFrame:
    return rollouts.groupBy(*keys, task).agg(F.avg(value).alias("value"), F.count("*").alias("rollouts"))


def run_summary(rollouts: DataFrame, keys: tuple[str, ...], value: str = "reward", task: str = "task") -> DataFrame:
    """Mean and population deviation over rollouts and over task means, tasks, rollouts and tasks without any reward."""
    over = rollouts.groupBy(*keys).agg(F.count("*").alias("rollout_count"), F.avg(value).alias("reward_mean"), F.stddev_pop(value).alias("rollout_std"))
    tasks = task_means(rollouts, keys, task, value).groupBy(*keys)
    by_task = tasks.agg(F.count("*").alias("task_count"), F.stddev_pop("value").alias("task_mean_std"), F.count_if(F.col("value") == 0).alias("zero_reward_tasks"))
    return _join_null_safe(over, by_task, keys)


def rollout_distribution(rollouts: DataFrame, keys: tuple[str, ...], task: str = "task") -> DataFrame:
    """Fewest and most rollouts of a task in each run, and whether they are as many for all."""
    counts = rollouts.groupBy(*keys, task).agg(F.count("*").alias("n")).groupBy(*keys)
    return counts.agg(F.min("n").alias("fewest"), F.max("n").alias("most")).withColumn("constant", F.col("fewest") == F.col("most"))


def pooled_skill(loss: Column, reference: Column) -> Column:
    """Aggregate: 1 - mean loss / mean reference; an error where the mean reference isn't positive."""
    r = F.avg(reference)
    return 1 - F.avg(loss) / F.when(r > 0, r).otherwise(F.raise_error(F.lit("the reference loss must be positive")))


#: Digits of task values that count when they are averaged exactly.
DIGITS = 4


def exact_mean(value: str) -> Column:
    """Aggregate: the mean of values of DIGITS digits, rounded half away from zero to two digits more.

    Sums of doubles depend on their order, and a mean that lies between two numbers of six digits
    may then be rounded either way. Here all is integer arithmetic until the last division.
    """
    units = F.sum(F.round(F.col(value) * 10**DIGITS).cast("decimal(28,0)"))
    n = F.count(value).cast("decimal(20,0)")
    twice = F.abs(units).cast("decimal(34,0)") * 200
    whole = F.floor((twice + n) / (2 * n))
    return F.signum(units.cast("double")) * whole.cast("double") / 10 ** (DIGITS + 2)


PROMPT_MODES = ("full", "matrix-only", "text-only", "shuffled-text")
UNIFORM_BRIER = 1 / 3


def prompt_mode_order(mode: Column) -> Column:
    """What prompt modes are sorted by: none first, then the known ones in their order, then others by name."""
    known = F.array_position(F.array(*map(F.lit, PROMPT_MODES)), mode) - 1
    place = F.when(mode.isNull(), F.lit(-1)).when(known >= 0, known).otherwise(F.lit(len(PROMPT_MODES)))
    return F.struct(place.cast("int").alias("place"), F.coalesce(mode, F.lit("")).alias("mode"))


def skill_contributions(losses: DataFrame, keys: tuple[str, ...], loss: str, reference: str) -> DataFrame:
    """`losses` plus `contribution`: 1 - loss / mean reference of its keys, whose mean is the pooled skill."""
    mean = losses.groupBy(*keys).agg(F.avg(reference).alias("__mean"))
    positive = F.when(F.col("__mean") > 0, F.col("__mean")).otherwise(F.raise_error(F.lit("the reference loss must be positive")))
    met = _join_null_safe(losses, mean, keys)
    return met.withColumn("contribution", 1 - F.col(loss) / positive).drop("__mean")


def diagnostic_values(metrics: DataFrame, forecast: Column) -> DataFrame:
    """`metrics` (keys, metric, value) and, where `forecast` holds, the skill against the uniform forecast of each loss."""
    skill = metrics.where(forecast & (F.col("metric") == "brier")).withColumn("metric", F.lit("brier_skill_vs_uniform")).withColumn("value", 1 - F.col("value") / F.lit(UNIFORM_BRIER))
    return metrics.unionByName(skill)


def stable_seed(seed: int, label: str) -> int:
    """A seed for a labelled stream: the first eight bytes of SHA-256 of the seed, a zero byte and the label."""
    return int.from_bytes(hashlib.sha256(f"{seed}\0{label}".encode()).digest()[:8], "big")


def draws(tasks: DataFrame, samples: int, seed: int, stratum: str = "stratum", task: str = "task", cluster: str | None = None) -> DataFrame:
    """(stratum, sample, task, times): how often each sample draws each task.

    Flat: as many tasks as there are, drawn with replacement. With clusters of which one has
    more than a task: clusters are drawn with replacement, then as many members of each drawn
    cluster as it has. Draws are counted before anything is joined with them.
    """
    keys = [stratum] + ([cluster] if cluster else [])
    # positions of clusters in their stratum, and of tasks in their cluster (or stratum)
    unique = tasks.select(*keys, task).distinct()
    placed = unique.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(task)) - 1)
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    numbered = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    if cluster is None:
        slots = sizes.select(stratum, "n", numbered).select(stratum, "n", "sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
        drawn = slots.select(stratum, "sample", F.pmod(hash60(F.lit(seed), F.col(stratum), F.col("sample"), F.col("slot")), F.col("n")).alias("place"))
        return drawn.groupBy(stratum, "sample", "place").agg(F.count("*").alias("times")).join(placed, [stratum, "place"]).select(stratum, "sample", task, "times")
    ranked = sizes.withColumn("c", F.row_number().over(Window.partitionBy(stratum).orderBy(cluster)) - 1)
    whole = sizes.groupBy(stratum).agg(F.count("*").alias("m"), F.max("n").alias("largest"))
    slots = whole.select(stratum, "m", numbered).select(stratum, "m", "sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("slot"))
    chosen = slots.select(stratum, "sample", "slot", F.pmod(hash60(F.lit(seed), F.col(stratum), F.lit("cluster"), F.col("sample"), F.col("slot")), F.col("m")).alias("c"))
    inner = chosen.join(ranked, [stratum, "c"]).select(stratum, cluster, "sample", "slot", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn"))
    drawn = inner.select(stratum, cluster, "sample", F.pmod(hash60(F.lit(seed), F.col(stratum), F.lit("member"), F.col("sample"), F.col("slot"), F.col("turn")), F.col("n")).alias("place"))
    return drawn.groupBy(stratum, cluster, "sample", "place").agg(F.count("*").alias("times")).join(placed, [stratum, cluster, "place"]).select(stratum, "sample", task, "times")


def bootstrap_means(values: DataFrame, drawn: DataFrame, keys: tuple[str, ...], stratum: str = "stratum", task: str = "task") -> DataFrame:
    """(keys, sample, mean) of task values under shared draws; `keys` include the stratum."""
    met = values.join(drawn, [stratum, task])
    return met.groupBy(*keys, "sample").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"))


def intervals(means: DataFrame, keys: tuple[str, ...], level: float = 0.95) -> DataFrame:
    """Percentile interval of the resampled means, interpolated linearly."""
    tail = (1 - level) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", tail).alias("ci_low"), F.percentile("mean", 1 - tail).alias("ci_high"))


def ranked_pairs(values: DataFrame, stratum: str = "stratum", model: str = "model") -> DataFrame:
    """(stratum, model_a, model_b) of every two models, the better mean first, of equal ones the first in caseless order."""
    means = values.groupBy(stratum, model).agg(F.avg("value").alias("mean"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc("mean"), F.lower(model), model)))
    a, b = (ranked.select(stratum, F.col(model).alias(f"model_{x}"), F.col("rank").alias(f"rank_{x}")) for x in "ab")
    return a.join(b, stratum).where("rank_a < rank_b").drop("rank_a", "rank_b")


def paired_differences(values: DataFrame, pairs: DataFrame, stratum: str = "stratum", model: str = "model", task: str = "task", extra: tuple[str, ...] = ()) -> DataFrame:
    """(stratum, model_a, model_b, task, difference) of every pair on every common task."""
    side = lambda x: values.select(stratum, *extra, task, F.col(model).alias(f"model_{x}"), F.col("value").alias(f"value_{x}")) if x == "a" else values.select(stratum, task, F.col(model).alias("model_b"), F.col("value").alias("value_b"))
    met = pairs.join(side("a"), [stratum, "model_a"]).join(side("b"), [stratum, "model_b", task])
    return met.select(stratum, *extra, "model_a", "model_b", task, (F.col("value_a") - F.col("value_b")).alias("difference"))


def sign_flip_p(differences: DataFrame, samples: int, seed: int, keys: tuple[str, ...], cluster: str = "task") -> DataFrame:
    """(keys, p_value): the two-sided p of a mean paired difference, one random sign for each cluster.

    (samples at least as extreme + 1) / (samples + 1); 1 where there is no difference at all.
    """
    sums = differences.groupBy(*keys, cluster).agg(F.sum("difference").alias("sum"), F.count("*").alias("n"))
    whole = sums.groupBy(*keys).agg((F.abs(F.sum("sum")) / F.sum("n")).alias("observed"), F.sum("n").alias("total"))
    flips = sums.select(*keys, cluster, "sum", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    sign = F.when(hash60(F.lit(seed), *[F.col(k) for k in keys], F.col(cluster), F.col("sample")) % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    null = flips.groupBy(*keys, "sample").agg(F.sum(sign * F.col("sum")).alias("signed"))
    met = null.join(whole, list(keys))
    exceed = met.groupBy(*keys).agg(F.count_if(F.abs(F.col("signed")) / F.col("total") + 1e-12 >= F.col("observed")).alias("exceed"), F.first("observed").alias("observed"))
    return exceed.select(*keys, F.when(F.col("observed") == 0, F.lit(1.0)).otherwise((F.col("exceed") + 1) / F.lit(samples + 1)).alias("p_value"))


def holm(tests: DataFrame, p: str = "p_value", order: tuple[str, ...] = ()) -> DataFrame:
    """`tests` plus holm_p and family_size: step-down adjusted over all rows as one family.

    The family is one ordered window by nature; it has a row for each comparison, not for data.
    """
    by = [F.col(p), *[F.col(c) for c in order]]
    ranked = tests.withColumn("__rank", F.row_number().over(Window.orderBy(*by))).withColumn("family_size", F.count("*").over(Window.partitionBy()))
    step = F.least(F.lit(1.0), (F.col("family_size") - F.col("__rank") + 1) * F.col(p))
    return ranked.withColumn("holm_p", F.max(step).over(Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0))).drop("__rank")


def pairwise(values: DataFrame, drawn: DataFrame, samples: int, seed: int, cluster: str | None = None) -> DataFrame:
    """Every pair of models of every stratum: mean difference, interval, sign-flip p, Holm p and both verdicts."""
    keys = ("stratum", "model_a", "model_b")
    pairs = ranked_pairs(values)
    diffs = paired_differences(values, pairs, extra=(cluster,) if cluster else ())
    means = diffs.groupBy(*keys).agg(exact_mean("difference").alias("mean_difference"))
    renamed = diffs.withColumnRenamed("difference", "value")
    ci = intervals(bootstrap_means(renamed, drawn, keys), keys)
    out = means.join(ci, list(keys)).join(sign_flip_p(diffs, samples, seed, keys, cluster or "task"), list(keys))
    out = holm(out, "p_value", keys)
    higher = lambda c: F.concat(F.col(c), F.lit(" higher"))
    by_interval = F.when(F.col("ci_low") > 0, higher("model_a")).when(F.col("ci_high") < 0, higher("model_b")).otherwise("interval includes 0")
    after = F.lit(" after Holm adjustment")
    by_holm = F.when((F.col("holm_p") <= 0.05) & (F.col("mean_difference") > 0), F.concat(higher("model_a"), after)).when((F.col("holm_p") <= 0.05) & (F.col("mean_difference") < 0), F.concat(higher("model_b"), after))
    return out.withColumn("interpretation", by_interval).withColumn("holm_interpretation", by_holm.otherwise("not significant after Holm adjustment"))


def ablations(values: DataFrame, drawn: DataFrame, full: str = "full") -> DataFrame:
    """Paired full-minus-mode differences of each model, metric and other prompt mode, with intervals under shared draws.

    `values` has stratum, model, metric, prompt_mode, task and value; tasks of both modes must be the same ones.
    """
    keys = ["stratum", "model", "metric"]
    a = values.where(F.col("prompt_mode") == full).select(*keys, "task", F.col("value").alias("full"))
    b = values.where(F.col("prompt_mode") != full).select(*keys, "prompt_mode", "task", F.col("value").alias("other"))
    diffs = a.join(b, [*keys, "task"]).withColumn("value", F.col("full") - F.col("other"))
    out = (*keys, "prompt_mode")
    means = diffs.groupBy(*out).agg(exact_mean("value").alias("mean_difference"), F.count("*").alias("tasks"))
    return means.join(intervals(bootstrap_means(diffs.select(*out, "task", "value"), drawn, out), out), list(out))


def _join_null_safe(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(right, on).drop(*[f"__{k}" for k in keys])
