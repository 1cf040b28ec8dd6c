"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage works on all that its predecessor kept. What they do with nulls, empty texts, ties,
repeated rows and clashing names is what their operators in plenara.llm say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenara.llm import bpe, decontam, linetree, neardup, quality
from plenara.llm.common import release, set_aside, table, tables, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base checks or the learned decision list reject go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    free, restored = set_aside(docs, quality.COLUMNS)
    return restored(quality.apply_rules(free, rules).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut, all but the first of each; n_chars follows the text.

    A text that would lose more than half of its words stays whole: it is a copy of others, of which
    the next stage leaves one, and a stub of it would no longer be told as one.
    """
    out = linetree.without_recurring_lines(docs, most=0.5)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded; the decoded text's digest shows that nothing was lost."""
    path = bpe.default_path()
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the learned list, the template tree's fixpoint, alignment classes or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`. What a stage has written on the way goes when its result is there, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        before = tables()
        out = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            out = written(out)
            own = {path for path in tables() - before if path != out.plenara_path}
            release(*own, *([docs] if number else []))
        docs = out
    return docs
