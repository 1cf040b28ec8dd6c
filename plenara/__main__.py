"""python -m plenara COMMAND: the plans from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m plenara", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    floors = commands.add_parser("floors", help="model-free forecasts of the held-out votes of a snapshot file")
    floors.add_argument("snapshots")
    floors.add_argument("--train")
    floors.add_argument("--masked", type=int)
    floors.add_argument("--seed")
    suite = commands.add_parser("suite", help="model-free references of a scenario file")
    suite.add_argument("scenarios")
    study = commands.add_parser("study", help="summaries, diagnostics, pairs and ablations of saved runs")
    study.add_argument("root")
    study.add_argument("--samples", type=int, default=20_000)
    study.add_argument("--seed", type=int, default=20240607)
    study.add_argument("--table", choices=["summaries", "diagnostics", "pairwise", "ablations"], default="summaries")
    intake = commands.add_parser("ingest", help="validate human sessions and publish them with a manifest")
    intake.add_argument("inputs", nargs="+")
    intake.add_argument("--output", required=True)
    intake.add_argument("--manifest", required=True)
    intake.add_argument("--schema-version", required=True)
    intake.add_argument("--source", required=True)
    intake.add_argument("--skip-invalid", action="store_true")
    splits = commands.add_parser("splits", help="generate scenario splits and audit them")
    splits.add_argument("folder")
    splits.add_argument("--repetitions", type=int, default=5)
    splits.add_argument("--seed", type=int, default=1)
    return parser


def main(arguments: list[str]) -> int:
    args = _parser().parse_args(arguments)
    from plenara.operators import audit, generate
    from plenara.plans import analysis, findings, floors
    from plenara.sources import jsonl, runs, schemas, sinks

    spark = SparkSession.builder.appName("plenara").getOrCreate()
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    if args.command == "floors":
        good, errors = jsonl.load_snapshots(spark, args.snapshots, args.masked, seed=args.seed)
        train = jsonl.load_snapshots(spark, args.train)[0] if args.train else None
        print(sinks.markdown(floors.snapshot_floors(good, masked=None, train=train)))
        return _told(errors)
    if args.command == "suite":
        good, errors = jsonl.load_scenarios(spark, args.scenarios)
        print(sinks.markdown(findings.reference_suite(good)))
        return _told(errors)
    if args.command == "study":
        loaded = [runs.load(spark, p) for p in runs.discover(args.root)]
        broken = sinks.rows_of(union([x[2] for x in loaded]))
        if broken:
            print(json.dumps(broken, indent=2), file=sys.stderr)
            return 1
        print(sinks.markdown(analysis.analyze(union([x[0] for x in loaded]), union([x[1] for x in loaded]), args.samples, args.seed)[args.table]))
        return 0
    if args.command == "ingest":
        accepted, manifest, errors = jsonl.ingest(spark, args.inputs, args.schema_version, args.source)
        if _told(errors) and not args.skip_invalid:
            return 1
        sinks.publish(sinks.rows_of(accepted), sinks.rows_of(manifest), args.output, args.manifest, args.schema_version)
        return 0
    names = list(generate.TEMPLATES)
    made = generate.splits(spark, names[:9], names[9:], args.repetitions, args.seed).persist()
    read = made.selectExpr("split", f"from_json(json, '{schemas.SCENARIO}') AS s").select("split", "s.*")
    prints = audit.scenario_fingerprints(read).join(read.selectExpr("scenario_id AS id", "split"), "id").drop("family").selectExpr("*", "CAST(NULL AS STRING) AS family")
    broken = sinks.rows_of(audit.split_integrity(prints))
    if broken:
        print(json.dumps(broken, indent=2), file=sys.stderr)
        return 1
    for split in ("train", "eval"):
        made.where(f"split = '{split}'").orderBy("scenario_id").select("json").coalesce(1).write.mode("overwrite").text(f"{args.folder}/{split}")
    return 0


def _told(errors: DataFrame) -> int:
    """Print errors; 1 if there are any."""
    from plenara.sources import sinks

    rows = sinks.rows_of(errors)
    for r in rows:
        print(json.dumps(r, default=str), file=sys.stderr)
    return int(bool(rows))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
