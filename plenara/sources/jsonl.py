"""Strict JSON-lines sources: rows that keep the schema, and errors that say why the others don't."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenara.functions import strict_json as J
from plenara.operators import matrix, validate
from plenara.sources import schemas

LINE_BYTES = 16 << 20
_READ = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))])


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, raw) of the rows of text files, which end at line feeds only; blank ones are skipped. Files are split among tasks."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(F.trim(F.regexp_replace("raw", r"\s", "")) != "")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, line, raw) of files in their order, lines from 1, which end at LF, CRLF or CR; blank ones are skipped.

    All files are read at once and split among tasks at line feeds. A line's number is what
    stands before it in its split, plus the lines of the file's splits before that.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    rows = read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.split(F.regexp_replace("value", r"\r\z", ""), "\r").alias("parts"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(F.size("parts")).over(inside), F.lit(0)))
    blocks = rows.groupBy("file", "block").agg(F.sum(F.size("parts")).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", offset.alias("offset"))
    order = spark.createDataFrame([(i, _address(spark, p)) for i, p in enumerate(paths)], "source int, file string")
    out = placed.join(starts, ["file", "block"]).join(order, "file").select("source", "offset", "before", F.posexplode("parts").alias("k", "raw"))
    return out.select("source", (F.col("offset") + F.col("before") + F.col("k") + 1).cast("int").alias("line"), "raw").where(F.trim(F.regexp_replace("raw", r"\s", "")) != "")


def _address(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers name it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return re.sub(r"^file:/+", "file:///", whole)


@F.pandas_udf(_READ)
def _strict(raw: pd.Series) -> pd.DataFrame:
    def one(text):
        if text is None:
            return None, "no text", None
        if len(text.encode("utf-8", "replace")) > LINE_BYTES:
            return None, f"row exceeds {LINE_BYTES} bytes", None
        try:
            value = J.loads(text)
        except (ValueError, RecursionError) as e:
            return None, f"not strict JSON: {e}"[:300], None
        if not isinstance(value, dict):
            return None, "row is no object", None
        return json.dumps(value), None, sorted(value)

    return pd.DataFrame([one(t) for t in raw], columns=["json", "error", "keys"])


def decoded(rows: DataFrame, schema: str, closed: bool = False, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, errors): rows (with raw) decoded by an explicit schema, and those that aren't strict JSON objects with its keys.

    `closed` also rejects keys beyond the schema, `lenient` takes missing ones as null. Types
    that don't fit reject the row.
    """
    wanted = sorted(T.DataType.fromDDL(schema).fieldNames())
    others = [c for c in rows.columns if c != "raw"]
    read = rows.select(*others, _strict("raw").alias("r"))
    keys = F.array().cast("array<string>") if lenient else F.array_except(F.lit(wanted), "r.keys")
    beyond = F.array_except("r.keys", F.lit(wanted)) if closed else F.array().cast("array<string>")
    error = F.coalesce(
        F.col("r.error"), F.when(F.size(keys) > 0, F.concat(F.lit("missing "), F.array_join(keys, ", "))), F.when(F.size(beyond) > 0, F.concat(F.lit("unexpected "), F.array_join(beyond, ", "))),
    )
    parsed = read.select(*others, error.alias("error"), F.from_json("r.json", f"{schema}, __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("v"))
    bad = F.coalesce("error", F.when(F.col("v").isNull() | F.col("v.__bad").isNotNull(), F.lit("a value has another type")))
    errors = parsed.withColumn("error", bad).where("error IS NOT NULL").select(*others, "error")
    return parsed.where(bad.isNull()).select(*others, "v.*").drop("__bad"), errors


#: Fields of a session's meta that only human sessions have.
GOVERNANCE = ("consent_scope", "redistribution_rights_approved", "schema_version", "exporter_version", "source_commit", "privacy_review")


def names_source(said: Column, source: str) -> Column:
    """Whether a text names a source, whatever its case, with _ for - or blanks at its ends."""
    return F.coalesce(F.translate(F.lower(F.trim(said)), "_", "-") == source, F.lit(False))


def says_human(raw: Column, source: str | None) -> Column:
    """Whether a row carries any mark of a human session: it isn't synthetic, names the source, or has a field of governance."""
    meta = F.get_json_object(raw, "$.meta")
    out = F.get_json_object(meta, "$.synthetic") == "false"
    if source is not None:
        out = out | names_source(F.get_json_object(meta, "$.source"), source)
    return F.coalesce(out, F.lit(False)) | F.coalesce(F.arrays_overlap(F.json_object_keys(meta), F.array(*map(F.lit, GOVERNANCE))), F.lit(False))


def load_snapshots(
    spark: SparkSession, path: str, masked_vote_count: int | None = None, min_cluster_count: int | None = None, seed: str | None = None, human: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(snapshots, errors) of a file of snapshots: decode, validate, filter by clusters, then mask.

    Any mark of a human session brings a row under the rules for those, whatever else it says;
    `human` has the schema version and the source that they must name (without it they are all
    errors). Masking keeps the file's own masked cells first. An empty result, or one with
    nothing held out anywhere, is an error to raise, not a table.
    """
    if not all(x is None or type(x) is int for x in (masked_vote_count, min_cluster_count)):
        raise ValueError("masked_vote_count and min_cluster_count must be integers or None")
    every = lines(spark, path).withColumn("__human", says_human(F.col("raw"), human[1] if human else None))
    rows, errors = decoded(every.where("NOT __human").drop("__human"), schemas.SNAPSHOT)
    broken = validate.snapshot_violations(rows)
    people, worse = decoded(every.where("__human").drop("__human"), schemas.HUMAN_SNAPSHOT)
    if human:
        broken = broken.unionByName(validate.human_violations(people, *human))
    else:
        broken = broken.unionByName(people.select("session_id", F.lit("human session").alias("rule")))
    common = T.DataType.fromDDL(schemas.SNAPSHOT).fieldNames()
    meta = F.struct(F.col("meta.k_anonymity"), F.col("meta.source"), F.lit(None).cast("string").alias("generator_family"), F.col("meta.synthetic"))
    rows = rows.select("file", *common).unionByName(validate.assigned(people).withColumn("meta", meta).select("file", *common))
    good = validate.valid(rows, broken, "session_id")
    errors = errors.unionByName(worse).unionByName(rows.select("file", "session_id").join(broken, "session_id").select("file", F.concat_ws(": ", "session_id", "rule").alias("error")))
    if min_cluster_count is not None:
        good = good.where(F.size(F.array_distinct("clusters")) >= min_cluster_count)
    if masked_vote_count is not None:
        own = matrix.held_out(good)
        visible, hidden = matrix.mask(matrix.known_votes(matrix.cells(good), own), masked_vote_count, seed, first=own)
        good = remasked(good, visible, hidden)
    if good.isEmpty():
        raise ValueError(f"no snapshot left in {path}")
    if good.where(F.size("masked_cells") > 0).isEmpty():
        raise ValueError(f"nothing is held out in {path}")
    return good, errors


def load_snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots as a file has them, checked for their dimensions only: nothing is masked, filtered or required to be held out."""
    rows, errors = decoded(lines(spark, path), schemas.SNAPSHOT)
    broken = validate.snapshot_violations(rows)
    said = errors.select("error").unionByName(broken.select(F.concat_ws(": ", "session_id", "rule").alias("error"))).limit(5).collect()
    if said:
        raise ValueError(f"{path}: " + "; ".join(r.error for r in said))
    return rows.drop("file")


def bundled_path(folder: str, split: str) -> str:
    """The file of a named split in a folder of them."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; valid splits: {', '.join(SPLITS)}")
    return f"{folder.rstrip('/')}/{SPLITS[split]}"


#: The files of the two splits.
SPLITS = {"eval": "eval_synthetic.jsonl", "train": "train_synthetic.jsonl"}


def train_split(spark: SparkSession, evaluated: str, train: str | None = None) -> str | None:
    """The training split that goes with an evaluated file: the one given, or the file's sibling if it is a bundled split; None where it isn't there."""
    if train is None:
        folder, _, name = evaluated.rpartition("/")
        train = f"{folder}/{SPLITS['train']}".lstrip("/" if not folder else "") if name == SPLITS["eval"] else None
    if train is None:
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(train)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return train if system.exists(place) and system.getFileStatus(place).isFile() else None


def remasked(snapshots: DataFrame, visible: DataFrame, hidden: DataFrame) -> DataFrame:
    """Nested snapshots with their votes, masked cells and held-out map taken from long form."""
    rows = visible.groupBy("session", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "vote"))), lambda x: x["vote"]).alias("row"))
    votes = rows.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "row"))), lambda x: x["row"]).alias("__votes"))
    listed = hidden.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "p", "s", "vote"))).alias("__h"))
    met = snapshots.join(votes.withColumnRenamed("session", "session_id"), "session_id").join(listed.withColumnRenamed("session", "session_id"), "session_id", "left")
    hid = F.coalesce("__h", F.array().cast("array<struct<rank:int,p:int,s:int,vote:int>>"))
    names = F.transform(hid, lambda x: F.struct(F.concat_ws(",", x["p"].cast("string"), x["s"].cast("string")), x["vote"]))
    out = met.withColumns({"votes": F.col("__votes"), "masked_cells": F.transform(hid, lambda x: F.array(x["p"], x["s"])), "held_out": F.map_from_entries(names)})
    return out.select(*snapshots.columns)


def load_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scenarios, errors) of a file of scenarios, validated in full."""
    rows, errors = decoded(lines(spark, path), schemas.SCENARIO, closed=True)
    broken = validate.scenario_violations(rows)
    errors = errors.unionByName(rows.select("file", "scenario_id").join(broken, "scenario_id").select("file", F.concat_ws(": ", "scenario_id", "rule").alias("error")))
    return validate.valid(rows, broken, "scenario_id"), errors


def load_scenario_rows(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios as a file has them, without validation; rows that don't decode are an error to raise."""
    rows, errors = decoded(lines(spark, path), schemas.SCENARIO)
    if not errors.isEmpty():
        raise ValueError(f"{path}: {errors.first().error}")
    return rows.drop("file")


def template_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(task, cluster): the base template of each scenario of a file, tasks counted from 0 in the order of its lines."""
    rows = numbered_lines(spark, [path]).select("line", F.get_json_object("raw", "$.provenance.template_id").alias("cluster"))
    missing = rows.where("cluster IS NULL OR trim(cluster) = ''").orderBy("line").first()
    if missing is not None:
        raise ValueError(f"{path}:{missing.line}: no template_id")
    if rows.isEmpty():
        raise ValueError(f"{path}: no scenario")
    # one row for each scenario of an evaluation split: a single ordered window is small
    return rows.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("task"), "cluster")


def ingest(spark: SparkSession, paths: list[str], schema_version: str, source: str, k: int = validate.LEAST_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, manifest, errors) of human sessions from several files; errors never abort the run.

    A session id belongs to the first valid row that has it, in order of files and lines; an
    invalid row never claims one.
    """
    rows, errors = decoded(numbered_lines(spark, paths), schemas.HUMAN_SNAPSHOT, closed=True)
    # rules are judged row by row, whatever session a row claims to be
    row = F.concat_ws(":", "source", "line")
    keyed = rows.withColumn("session_id", row)
    broken = validate.human_violations(keyed, schema_version, source, k)
    broken = broken.unionByName(validate.violations(rows.select(row.alias("row"), "session_id"), "row", {"session id": F.coalesce(F.trim("session_id") != "", F.lit(False))}).withColumnRenamed("row", "session_id"))
    reasons = broken.groupBy(F.col("session_id").alias("__row")).agg(F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("error"))
    errors = errors.unionByName(rows.withColumn("__row", row).join(reasons, "__row").select("source", "line", "error"))
    good = rows.withColumn("__row", row).join(reasons.select("__row"), "__row", "left_anti").drop("__row")
    ranked = good.withColumn("__nth", F.expr("row_number() OVER (PARTITION BY session_id ORDER BY source, line)"))
    errors = errors.unionByName(ranked.where("__nth > 1").select("source", "line", F.concat(F.lit("duplicate session_id: "), "session_id").alias("error")))
    accepted = ranked.where("__nth = 1").drop("__nth")
    manifest = accepted.select(
        "source", "line", "session_id", F.size("participants").alias("participant_count"), F.size("statements").alias("statement_count"), F.size("clusters").alias("cluster_count"),
        *[F.col(f"meta.{c}").alias(c) for c in ("k_anonymity", "consent_scope", "redistribution_rights_approved", "schema_version", "exporter_version", "source_commit", "privacy_review")],
    )
    return accepted.drop("source", "line"), manifest, errors
