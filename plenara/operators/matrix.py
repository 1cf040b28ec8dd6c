"""Vote matrices in long form: one row for each cell of each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenara.functions import votes as V

#: A session's matrix in long form: session, p(articipant) and s(tatement) from 0, vote or null.
CELL = "session string, p int, s int, vote int"


def cells(snapshots: DataFrame) -> DataFrame:
    """The cells of nested snapshots (session_id, votes as rows of participants)."""
    rows = snapshots.select(F.col("session_id").alias("session"), F.posexplode("votes").alias("p", "row"))
    return rows.select("session", "p", F.posexplode("row").alias("s", "vote")).withColumn("vote", F.col("vote").cast("int"))


def held_out(snapshots: DataFrame) -> DataFrame:
    """(session, p, s, vote, at) of the held-out map; at is the cell's place in masked_cells, null if it isn't there."""
    kept = snapshots.select(F.col("session_id").alias("session"), F.explode("held_out").alias("cell", "vote"), "masked_cells")
    part = lambda n: F.split("cell", ",")[n].cast("int")
    at = F.array_position(F.transform("masked_cells", lambda c: F.concat_ws(",", c[0].cast("string"), c[1].cast("string"))), F.col("cell"))
    return kept.select("session", part(0).alias("p"), part(1).alias("s"), F.col("vote").cast("int").alias("vote"), F.nullif(at, F.lit(0)).cast("int").alias("at"))


def known_votes(matrix: DataFrame, hidden: DataFrame) -> DataFrame:
    """The matrix with its held-out votes put back."""
    back = hidden.select("session", "p", "s", F.col("vote").alias("__held"))
    return matrix.join(back, ["session", "p", "s"], "left").select("session", "p", "s", F.coalesce("__held", "vote").alias("vote"))


def mask_rank(seed: str | None = None) -> Column:
    """The hash that orders cells for masking: SHA-256 of [seed:]session:p,s as hex."""
    cell = F.concat(F.col("session").cast("string"), F.lit(":"), F.col("p").cast("string"), F.lit(","), F.col("s").cast("string"))
    return F.sha2(cell if seed is None else F.concat(F.lit(f"{seed}:"), cell), 256)


def mask(full: DataFrame, count: int, seed: str | None = None, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(visible cells, held-out cells): `count` known cells of each session are hidden.

    Cells of `first` (session, p, s, at) go first in their order, then cells by mask_rank; a
    negative count hides none, and no more are hidden than are known.
    """
    known = full.where(F.col("vote").isin(-1, 0, 1))
    if first is not None:
        known = known.join(first.select("session", "p", "s", "at"), ["session", "p", "s"], "left")
    else:
        known = known.withColumn("at", F.lit(None).cast("int"))
    order = Window.partitionBy("session").orderBy(F.col("at").asc_nulls_last(), mask_rank(seed), "p", "s")
    hidden = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(count, 0)).select("session", "p", "s", "vote", "rank")
    left = full.join(hidden.select("session", "p", "s", F.lit(True).alias("__hidden")), ["session", "p", "s"], "left")
    visible = left.select("session", "p", "s", F.when(F.col("__hidden"), F.lit(None)).otherwise(F.col("vote")).cast("int").alias("vote"))
    return visible, hidden


def comment_stats(matrix: DataFrame) -> DataFrame:
    """Counts, smoothed shares and z-scores of every statement."""
    seen = F.count("vote").alias("seen")
    counted = matrix.groupBy("session", "s").agg(*V.class_counts(F.col("vote")), seen)
    return counted.select(
        "session", "s", "agree", "disagree", "pass", "seen",
        V.laplace(F.col("agree"), F.col("seen")).alias("pa"), V.laplace(F.col("disagree"), F.col("seen")).alias("pd"),
        V.prop_test(F.col("agree"), F.col("seen")).alias("pat"), V.prop_test(F.col("disagree"), F.col("seen")).alias("pdt"),
    )


def vote_spread(matrix: DataFrame, *keys: str) -> DataFrame:
    """Entropy and separation of the votes of each key, and their mean, the disagreement."""
    counted = matrix.groupBy(*keys).agg(*V.class_counts(F.col("vote")))
    three = [F.col(k) for k in V.LABELS]
    spread = counted.select(*keys, V.entropy(*three).alias("entropy"), V.separation(*three).alias("separation"))
    return spread.withColumn("disagreement", (F.col("entropy") + F.col("separation")) / 2)


def cluster_representativeness(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """z of each cluster's agreement with each statement against that of all others; members: (session, p, cluster)."""
    seen = matrix.where(F.col("vote").isNotNull()).join(members, ["session", "p"])
    inside = seen.groupBy("session", "cluster", "s").agg(F.count_if(F.col("vote") == 1).alias("hits_in"), F.count("*").alias("seen_in"))
    whole = seen.groupBy("session", "s").agg(F.count_if(F.col("vote") == 1).alias("hits"), F.count("*").alias("seen"))
    both = inside.join(whole, ["session", "s"]).withColumn("hits_out", F.col("hits") - F.col("hits_in")).withColumn("seen_out", F.col("seen") - F.col("seen_in"))
    z = V.two_prop_test(F.col("hits_in"), F.col("hits_out"), F.col("seen_in"), F.col("seen_out"))
    return both.select("session", "cluster", "s", "hits_in", "hits_out", "seen_in", "seen_out", z.alias("z"))


def class_prior(matrix: DataFrame, *keys: str, smoothing: float = 0.0) -> DataFrame:
    """(keys, pa, pd, pp): class shares of the visible votes of each key (of everything without keys); uniform of none."""
    counted = matrix.groupBy(*keys).agg(*V.class_counts(F.col("vote")))
    total = sum((F.col(k) for k in V.LABELS), F.lit(3 * smoothing))
    share = lambda k: F.when(total > 0, (F.col(k) + smoothing) / total).otherwise(F.lit(1 / 3))
    return counted.select(*keys, share("agree").alias("pa"), share("disagree").alias("pd"), share("pass").alias("pp"))
