"""Saved evaluation runs: discovery of run folders, and both file layouts as long tables.

Rollouts are (run_id, environment, model, prompt_mode, ts_ns, task, rollout, reward), metrics
(run_id, task, rollout, metric, value), violations (run_id, rule, detail).
"""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenara.functions import strict_json as J
from plenara.sources import jsonl

#: The files of the two layouts.
SAVED, TRACED = ("metadata.json", "results.jsonl"), ("config.toml", "traces.jsonl")
LAYOUTS = ("*/*", "outputs/evals/*/*", "outputs/*/*", "environments/*/outputs/evals/*/*")
RESULTS = "example_id BIGINT, reward DOUBLE, error STRING, is_completed BOOLEAN, is_truncated BOOLEAN, answer STRING, metrics MAP<STRING, DOUBLE>"
TRACES = (
    "id STRING, ok BOOLEAN, errors ARRAY<STRING>, traces ARRAY<STRUCT<id: STRING, is_completed: BOOLEAN, ok: BOOLEAN, errors: ARRAY<STRING>,"
    " task: STRUCT<type: STRING, data: STRUCT<idx: BIGINT, answer: STRING>>, rewards: MAP<STRING, STRUCT<score: DOUBLE, weight: DOUBLE>>, metrics: MAP<STRING, DOUBLE>>>"
)


def discover(root: str) -> list[Path]:
    """The result files of all complete runs below a folder; partial or ambiguous runs are errors, and so is finding none."""
    folders = sorted({p for layout in LAYOUTS for p in Path(root).glob(layout) if p.is_dir()})
    found, partial, only_logs = [], [], 0
    for folder in folders:
        saved, traced = ([(folder / n).is_file() for n in names] for names in (SAVED, TRACED))
        if all(saved) and all(traced):
            raise ValueError(f"both layouts in {folder}")
        if all(saved) and not any(traced):
            found.append(folder / SAVED[1])
        elif all(traced) and not any(saved):
            found.append(folder / TRACED[1])
        elif any(saved + traced):
            partial.append(folder)
        else:
            only_logs += any(folder.glob("*.log"))
    if partial:
        raise ValueError("partially saved runs: " + ", ".join(map(str, partial)))
    if not found:
        raise ValueError(f"no saved run under {root}" + (f"; {only_logs} folders hold logs only" if only_logs else ""))
    return found


def load(spark: SparkSession, result: Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rollouts, metrics, violations) of one run."""
    return load_saved(spark, result) if result.name == SAVED[1] else load_traced(spark, result)


def _long(rows: DataFrame, head: dict, expected: int, per_task: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: task, line, reward, metrics, answer, fault."""
    named = rows.select(*[F.lit(v).alias(k) for k, v in head.items()], "*")
    order = F.expr("row_number() OVER (PARTITION BY task ORDER BY line)")
    numbered = named.withColumn("rollout", order)
    rollouts = numbered.select("run_id", "environment", "model", "prompt_mode", "ts_ns", "task", "rollout", "reward")
    metrics = numbered.select("run_id", "task", "rollout", F.explode("metrics").alias("metric", "value"))
    run = F.lit(head["run_id"]).alias("run_id")
    total = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected)
    counts = rows.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("answers"))
    names = rows.select(F.array_sort(F.map_keys("metrics")).alias("k")).distinct().agg(F.count("*").alias("n")).where("n > 1")
    faults = [
        total.select(run, F.lit("rollout count").alias("rule"), F.concat(F.lit(f"expected {expected}, found "), F.col("n").cast("string")).alias("detail")),
        counts.where(F.col("n") != per_task).select(run, F.lit("rollouts of a task").alias("rule"), F.concat_ws(": ", F.col("task").cast("string"), F.col("n").cast("string")).alias("detail")),
        counts.where("answers > 1").select(run, F.lit("answers of a task differ").alias("rule"), F.col("task").cast("string").alias("detail")),
        names.select(run, F.lit("metrics differ").alias("rule"), F.col("n").cast("string").alias("detail")),
        rows.where("fault IS NOT NULL").select(run, F.col("fault").alias("rule"), F.col("line").cast("string").alias("detail")),
        rows.where("reward IS NULL OR isnan(reward) OR abs(reward) = double('infinity')").select(run, F.lit("reward is not finite").alias("rule"), F.col("line").cast("string").alias("detail")),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return rollouts, metrics, out


def _rows(spark: SparkSession, result: Path, schema: str) -> DataFrame:
    """The lines of a result file with their numbers, each a strict JSON object: repeated keys, NaN and what follows a value are errors."""
    rows, errors = jsonl.decoded(jsonl.numbered_lines(spark, [str(result)]), schema, lenient=True)
    first = errors.orderBy("line").first()
    if first is not None:
        raise ValueError(f"{result}:{first.line}: {first.error}")
    return rows


def load_saved(spark: SparkSession, result: Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    meta = J.loads((result.parent / SAVED[0]).read_text(encoding="utf-8"))
    for key, kind in (("env_id", str), ("model", str), ("num_examples", int), ("rollouts_per_example", int)):
        if not isinstance(meta.get(key), kind) or isinstance(meta[key], bool) or not meta[key]:
            raise ValueError(f"{result.parent / SAVED[0]}: {key}")
    args = meta.get("env_args") or {}
    environment = meta["env_id"] + (f"/{args['task']}" if isinstance(args.get("task"), str) else "")
    head = {"run_id": result.parent.name, "environment": environment, "model": meta["model"], "prompt_mode": args.get("prompt_mode"), "ts_ns": result.stat().st_mtime_ns}
    read = _rows(spark, result, RESULTS)
    fault = F.when(F.col("error").isNotNull(), F.lit("rollout with an error")).when(~F.coalesce("is_completed", F.lit(False)), F.lit("incomplete rollout")).when(F.coalesce("is_truncated", F.lit(False)), F.lit("truncated rollout"))
    rows = read.select(F.col("example_id").alias("task"), "line", "reward", F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"), F.sha2("answer", 256).alias("answer"), fault.alias("fault"))
    return _long(rows, head, meta["num_examples"] * meta["rollouts_per_example"], meta["rollouts_per_example"])


def load_traced(spark: SparkSession, result: Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    config = tomllib.loads((result.parent / TRACED[0]).read_text(encoding="utf-8"))
    taskset = config.get("env", {}).get("taskset", {})
    name = taskset.get("id") or config.get("env", {}).get("id")
    if not name or not config.get("model"):
        raise ValueError(f"{result.parent / TRACED[0]}: model or environment")
    head = {"run_id": result.parent.name, "environment": name + (f"/{taskset['task_mode']}" if taskset.get("task_mode") else ""), "model": config["model"], "prompt_mode": taskset.get("prompt_mode"), "ts_ns": result.stat().st_mtime_ns}
    read = _rows(spark, result, TRACES)
    t = F.get("traces", F.lit(0))
    reward = F.aggregate(F.map_values(t["rewards"]), F.lit(0.0), lambda s, r: s + r["score"] * r["weight"])
    named = F.map_concat(F.coalesce(t["metrics"], F.create_map().cast("map<string,double>")), F.transform_values(t["rewards"], lambda k, r: r["score"]))
    fault = F.when(F.size("traces") != 1, F.lit("episode without exactly one trace")).when(~(F.coalesce("ok", F.lit(False)) & F.coalesce(t["ok"], F.lit(False))), F.lit("failed trace")).when(~F.coalesce(t["is_completed"], F.lit(False)), F.lit("incomplete trace"))
    rows = read.select(t["task"]["data"]["idx"].alias("task"), "line", reward.alias("reward"), named.alias("metrics"), F.sha2(t["task"]["data"]["answer"], 256).alias("answer"), fault.alias("fault"), t["id"].alias("trace"))
    out = _long(rows.drop("trace"), head, int(config.get("num_tasks", 0)) * int(config.get("num_rollouts", 1)), int(config.get("num_rollouts", 1)))
    again = rows.groupBy("trace").count().where("count > 1").select(F.lit(head["run_id"]).alias("run_id"), F.lit("repeated trace id").alias("rule"), F.col("trace").alias("detail"))
    return out[0], out[1], out[2].unionByName(again)
