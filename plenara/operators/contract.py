"""The strict response contract: answers against held-out cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenara.functions import strict_json as J
from plenara.functions import votes as V


def contract_scores(answers: DataFrame, held_out: DataFrame) -> DataFrame:
    """(task, ok, probability_reward, vote_accuracy, brier) of each answer (task, text).

    An answer is right in form if it names exactly the task's held-out cells, each with a valid
    distribution. Otherwise reward and accuracy are 0 and the loss is 1, or 0 where nothing is
    held out. `held_out` has (task, cell, vote).
    """
    read = answers.select("task", J.forecast_cells(F.col("text")).alias("cells"))
    said = read.select("task", F.explode("cells").alias("c")).select("task", "c.cell", "c.pa", "c.pd", "c.pp", F.lit(True).alias("said"))
    both = held_out.join(said, ["task", "cell"], "full_outer")
    loss = V.brier(F.col("pa"), F.col("pd"), F.col("pp"), F.col("vote"))
    hit = V.argmax_vote(F.col("pa"), F.col("pd"), F.col("pp")) == F.col("vote")
    per_task = both.groupBy("task").agg(
        F.bool_and(F.col("vote").isNotNull() & F.col("said").isNotNull()).alias("exact"), F.count("vote").alias("held"),
        F.avg(loss).alias("loss"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("hits"),
    )
    met = read.join(per_task, "task", "left")
    ok = F.col("cells").isNotNull() & F.coalesce("exact", F.size("cells") == 0)
    held = F.coalesce("held", F.lit(0)) > 0
    right = ok & held
    return met.select(
        "task", ok.alias("ok"), F.when(right, 1 - F.col("loss")).otherwise(F.lit(0.0)).alias("probability_reward"),
        F.when(right, F.col("hits")).otherwise(F.lit(0.0)).alias("vote_accuracy"), F.when(right, F.col("loss")).otherwise(F.when(held, F.lit(1.0)).otherwise(F.lit(0.0))).alias("brier"),
    )


def last_answers(turns: DataFrame, keys: tuple[str, ...] = ("conv_id",), skip_non_text: bool = True) -> DataFrame:
    """(keys, text) of each conversation's last assistant turn; an empty text where there is none."""
    said = J.last_said(F.col("role"), F.col("text"), F.col("turn"), skip_non_text)
    return turns.groupBy(*keys).agg(F.coalesce(said, F.lit("")).alias("text"))
