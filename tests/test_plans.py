"""The analysis of runs, split audits and the command line."""

import random

import pytest
from pyspark.sql import functions as F

from plenara import __main__ as cli
from plenara.operators import audit, generate
from plenara.plans import analysis
from plenara.sources import schemas


def rollouts(spark):
    rnd, rows, metrics = random.Random(1), [], []
    for model, bonus in (("low", 0.0), ("high", 0.4)):
        for mode in ("full", "matrix-only"):
            for task in range(12):
                for k in (1, 2):
                    reward = min(1.0, max(0.0, 0.3 + bonus + 0.1 * (mode == "full") + rnd.uniform(-0.1, 0.1)))
                    rows.append((f"{model}-{mode}", "env", model, mode, 5, task, k, reward))
                    metrics += [(f"{model}-{mode}", task, k, "brier", 1 - reward), (f"{model}-{mode}", task, k, "original_snapshot_visible_prior_brier", 0.8)]
    rows += [("old", "env", "low", "full", 1, task, k, 1.0) for task in range(12) for k in (1, 2)]
    r = spark.createDataFrame(rows, "run_id string, environment string, model string, prompt_mode string, ts_ns long, task long, rollout int, reward double")
    return r, spark.createDataFrame(metrics, "run_id string, task long, rollout int, metric string, value double")


def test_analysis_of_runs(spark):
    r, m = rollouts(spark)
    assert analysis.violations(r.where("run_id <> 'old'")).count() == 0 and analysis.violations(r.where("run_id <> 'old' AND NOT (model = 'low' AND task = 3)")).count() == 2
    clusters = spark.createDataFrame([("env", t, t // 3) for t in range(12)], "environment string, task long, cluster long")
    for given in (None, clusters):
        out = analysis.analyze(r, m, 1000, 3, clusters=given)
        summary = {(x.stratum, x.model): x for x in out["summaries"].collect()}
        assert len(summary) == 4 and all(x.ci_low <= x.reward_mean <= x.ci_high and x.task_count == 12 and x.rollout_count == 24 for x in summary.values())
        assert summary["env/full", "low"].reward_mean < 0.6
        pair = {x.stratum: x for x in out["pairwise"].collect()}["env/full"]
        assert (pair.model_a, pair.model_b, pair.interpretation) == ("high", "low", "high higher") and pair.family_size == 2 and pair.p_value <= pair.holm_p
    diagnostics = {(x.stratum, x.model, x.metric): x for x in out["diagnostics"].collect()}
    own = diagnostics["env/full", "high", "brier"]
    skill = diagnostics["env/full", "high", analysis.POOLED[0]]
    assert own.ci_low <= own.task_mean <= own.ci_high and skill.ci_low <= 1 - own.task_mean / 0.8 <= skill.ci_high
    ablation = out["ablations"].where("model = 'high'").first()
    assert ablation.prompt_mode == "matrix-only" and ablation.tasks == 12 and ablation.ci_low <= ablation.mean_difference <= ablation.ci_high
    with pytest.raises(ValueError):
        analysis.analyze(r, m, 10)


def test_split_audit(spark):
    names = list(generate.TEMPLATES)
    made = generate.splits(spark, names[:3], names[3:6], 2, 1)
    read = made.select("split", F.from_json("json", schemas.SCENARIO).alias("s")).select("split", "s.*")
    prints = audit.scenario_fingerprints(read).join(read.select(F.col("scenario_id").alias("id"), "split"), "id")
    rules = {x.rule for x in audit.split_integrity(prints.drop("family").withColumn("family", F.col("split"))).collect()}
    assert rules == set()
    leaked = prints.unionByName(prints.where("split = 'train'").limit(1).withColumn("split", F.lit("eval")))
    rules = {x.rule for x in audit.split_integrity(leaked, most_alike=0.95, retired=leaked.select("id").limit(1)).collect()}
    assert {"instance in both splits", "semantics in both splits", "generator family in both splits", "retired id", "splits too alike"} <= rules


def test_command_line(spark, tmp_path, capsys):
    generate.sessions(spark, 6, seed=2).drop("latent").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).coalesce(1).write.text(f"{tmp_path}/s")
    assert cli.main(["floors", f"{tmp_path}/s", "--train", f"{tmp_path}/s"]) == 0
    assert "| neighbors |" in capsys.readouterr().out
    assert cli.main(["splits", f"{tmp_path}/out", "--repetitions", "1"]) == 0
    assert cli.main(["suite", f"{tmp_path}/out/train"]) == 0
