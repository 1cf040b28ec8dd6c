"""Analysis of evaluation runs: newest runs, summaries, shared resamples, diagnostics, pairs and prompt ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.operators import study

LEAST_SAMPLES = 1000
#: A metric that is a ratio of two means, which each resample forms anew: (name, loss, reference loss).
POOLED = ("brier_skill_vs_visible_prior", "brier", "original_snapshot_visible_prior_brier")


def _stratum() -> Column:
    return F.concat_ws("/", "environment", F.coalesce("prompt_mode", F.lit("default")))


def violations(rollouts: DataFrame) -> DataFrame:
    """(stratum, rule, detail): models of a stratum with other tasks than its other models, and unequal rollouts of tasks."""
    seen = rollouts.select(_stratum().alias("stratum"), "model", "task", "rollout")
    tasks = seen.select("stratum", "model", "task").distinct()
    models = tasks.groupBy("stratum").agg(F.count_distinct("model").alias("models"))
    partly = tasks.groupBy("stratum", "task").agg(F.count("*").alias("n")).join(models, "stratum").where("n < models")
    uneven = seen.groupBy("stratum", "model", "task").agg(F.count("*").alias("n")).groupBy("stratum", "model").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a <> b")
    return partly.select("stratum", F.lit("task missing for a model").alias("rule"), F.col("task").cast("string").alias("detail")).unionByName(uneven.select("stratum", F.lit("rollouts differ among tasks").alias("rule"), F.col("model").alias("detail")))


def analyze(rollouts: DataFrame, metrics: DataFrame, samples: int = 20_000, seed: int = 20240607, level: float = 0.95, clusters: DataFrame | None = None) -> dict[str, DataFrame]:
    """summaries, diagnostics, pairwise and ablations of rollouts and metrics in long form (see sources.runs).

    Only the newest run of each environment, model and prompt mode counts. All models and
    metrics of a stratum share its draws. `clusters` (environment, task, cluster) makes
    resampling hierarchical where a cluster has several tasks, and flips signs by cluster.
    """
    if samples < LEAST_SAMPLES:
        raise ValueError(f"at least {LEAST_SAMPLES} samples")
    heads = rollouts.select("run_id", *study.RUN, "ts_ns").distinct()
    newest = study.newest_runs(heads, time="ts_ns").select("run_id", *study.RUN)
    kept = rollouts.join(newest.select("run_id"), "run_id", "left_semi").withColumn("stratum", _stratum())
    keys = ("stratum", "model")
    values = study.task_means(kept, keys).select(*keys, "task", "value")
    if clusters is not None:
        named = clusters.join(kept.select("environment", "stratum").distinct(), "environment").select("stratum", "task", "cluster")
        values = values.join(named, ["stratum", "task"])
    cluster = "cluster" if clusters is not None else None
    drawn = study.draws(values, samples, seed, cluster=cluster)
    summary = study.run_summary(kept, keys).join(study.intervals(study.bootstrap_means(values, drawn, keys), keys, level), list(keys))
    # metrics: task means, then the same draws
    tagged = metrics.join(kept.select("run_id", "stratum", "model", "task", "rollout"), ["run_id", "task", "rollout"])
    by = ("stratum", "model", "metric")
    task_values = study.task_means(tagged, by, value="value").select(*by, "task", "value")
    resampled = study.bootstrap_means(task_values, drawn, by)
    name, loss, reference = POOLED
    both = resampled.groupBy("stratum", "model", "sample").agg(F.max(F.when(F.col("metric") == loss, F.col("mean"))).alias("a"), F.max(F.when(F.col("metric") == reference, F.col("mean"))).alias("b"))
    pooled = both.where("b > 0").select("stratum", "model", F.lit(name).alias("metric"), "sample", (1 - F.col("a") / F.col("b")).alias("mean"))
    rollout_stats = tagged.groupBy(*by).agg(F.count("*").alias("rollout_count"), F.avg("value").alias("rollout_mean"), F.stddev_pop("value").alias("rollout_std"))
    task_stats = task_values.groupBy(*by).agg(F.count("*").alias("task_count"), F.avg("value").alias("task_mean"), F.stddev_pop("value").alias("task_mean_std"))
    diagnostics = study.intervals(resampled.unionByName(pooled), by, level).join(rollout_stats, list(by), "left").join(task_stats, list(by), "left")
    pairs = study.pairwise(values, drawn, samples, seed, cluster)
    # ablations share draws across the modes of an environment
    modes = kept.where("prompt_mode IS NOT NULL").select(F.col("environment").alias("stratum"), "model", F.lit("reward").alias("metric"), "prompt_mode", "task", "reward")
    moded = modes.groupBy("stratum", "model", "metric", "prompt_mode", "task").agg(F.avg("reward").alias("value"))
    ablations = study.ablations(moded, study.draws(moded.select("stratum", "task").distinct(), samples, seed))
    return {"summaries": summary, "diagnostics": diagnostics, "pairwise": pairs, "ablations": ablations}
