"""Matching of submitted answers with reference items: stages, assignments, utilities.

Edges are rows (task, cand, item, and one boolean for each stage). Sizes are rows
(task, n_candidates, n_items); a task without any edge still gets its scores.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenara.functions import text as X
from plenara.functions import votes as V

#: Stages from the loosest to the strictest.
STAGES = ("localized", "typed", "diagnosed", "related")
OVERLAP, COVERAGE, PRECISION = 0.8, 0.9, 0.8
#: Items up to which the matching is counted by subsets of items in SQL; beyond that by augmenting paths.
FEW_ITEMS = 4
GROUNDING_SHARE, STANCE_SHARE = 0.5, 0.5
#: What a decision says in public.
PROFILE = ("actor", "action", "condition", "anchor_outcome", "alternative_outcome")


def evidence_matches(overlap: Column, coverage: Column, precision: Column, contiguous: Column, same_document: Column) -> Column:
    """Whether a submitted quote is the expected evidence."""
    return same_document & contiguous & (coverage >= COVERAGE) & (precision >= PRECISION) & (overlap >= OVERLAP)


def matching_size(edges: DataFrame, sizes: DataFrame, *stages: str) -> DataFrame:
    """(task, each stage): the greatest number of candidates and items that pair off along the stage's edges.

    For few items this is the least, over all subsets of them, of the items outside the subset
    plus the candidates with an edge into it (Koenig), which takes one aggregation.
    """
    stages = stages or STAGES
    few = sizes.where(F.col("n_items") <= FEW_ITEMS)
    items = edges.select("task", "item").distinct().withColumn("bit", F.row_number().over(Window.partitionBy("task").orderBy("item")) - 1)
    bits = edges.join(items, ["task", "item"]).join(few.select("task"), "task", "left_semi")
    flag = lambda s: F.when(F.col(s), F.expr("shiftleft(1, bit)")).otherwise(F.lit(0))
    masks = bits.groupBy("task", "cand").agg(*[F.bit_or(flag(s)).alias(s) for s in stages])
    subsets = range(1 << FEW_ITEMS)
    met = [F.count_if(F.col(s).bitwiseAND(F.lit(k)) != 0).alias(f"{s}_{k}") for s in stages for k in subsets]
    counted = few.join(masks.groupBy("task").agg(*met), "task", "left")
    width = lambda k: bin(k).count("1")
    size = lambda s: F.least(*[F.lit(FEW_ITEMS - width(k)) + F.coalesce(f"{s}_{k}", F.lit(0)) for k in subsets])
    out = counted.select("task", *[size(s).cast("int").alias(s) for s in stages])
    many = sizes.where(F.col("n_items") > FEW_ITEMS).select("task")
    schema = "task " + edges.schema["task"].dataType.simpleString() + "".join(f", {s} int" for s in stages)

    def per_task(frame: pd.DataFrame) -> pd.DataFrame:
        row = {"task": frame["task"].iloc[0]}
        for s in stages:
            chosen = frame[frame[s].astype(bool)]
            row[s] = pairs_off({c: g["item"].tolist() for c, g in chosen.groupby("cand")})
        return pd.DataFrame([row])

    paths = edges.join(many, "task", "left_semi").groupBy("task").applyInPandas(per_task, schema)
    rest = many.join(paths, "task", "left").select("task", *[F.coalesce(s, F.lit(0)).alias(s) for s in stages])
    return out.unionByName(rest)


def pairs_off(neighbors: dict) -> int:
    """The size of a greatest matching, by augmenting paths."""
    owner: dict = {}

    def place(node, tried: set) -> bool:
        for item in neighbors[node]:
            if item not in tried:
                tried.add(item)
                if item not in owner or place(owner[item], tried):
                    owner[item] = node
                    return True
        return False

    return sum(place(node, set()) for node in neighbors)


def stage_scores(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Matches, recalls, F1 of all stages, and the training reward (their mean), for every task."""
    m = matching_size(edges, sizes).join(sizes, "task")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    items, both = F.col("n_items"), F.col("n_items") + F.col("n_candidates")
    f1 = {s: share(2 * F.col(s), both) for s in STAGES}
    return m.select(
        "task", F.col("related").alias("true_positive"), (F.col("n_candidates") - F.col("related")).alias("false_positive"), (items - F.col("related")).alias("false_negative"),
        f1["related"].alias("f1"), share(F.col("localized"), items).alias("localization_recall"), share(F.col("typed"), F.col("localized")).alias("type_accuracy"),
        share(F.col("typed"), items).alias("type_recall"), share(F.col("diagnosed"), items).alias("diagnosis_recall"), share(F.col("related"), items).alias("relation_recall"),
        *[c.alias(f"{s}_f1") for s, c in f1.items()], (sum(f1.values(), F.lit(0.0)) / len(STAGES)).alias("training_reward"),
    )


def attainable(decision_value: Column, disagreement: Column, polarization: float) -> Column:
    """What asking about an item is worth at most."""
    return decision_value * ((1 - polarization) + polarization * disagreement)


def stance_disagreement(stances: Column) -> Column:
    """Mean of entropy and separation of a map of faction to agree, disagree or pass."""
    said = F.map_values(stances)
    count = lambda label: F.size(F.filter(said, lambda x: x == label))
    counts = [count(label) for label in V.LABELS]
    return (V.entropy(*counts) + V.separation(*counts)) / 2


def oriented_stances(alternative: Column, yes_choice: Column) -> Column:
    """What factions say if yes means `yes_choice`: the alternative's stances, or for anchor the same with agree and disagree swapped; null otherwise."""
    swap = lambda k, v: F.when(v == "agree", F.lit("disagree")).when(v == "disagree", F.lit("agree")).otherwise(v)
    return F.when(yes_choice == "alternative", alternative).when(yes_choice == "anchor", F.transform_values(alternative, swap))


def stance_accuracy(said: Column, expected: Column) -> Column:
    """Share of factions whose stance is right; null if the factions aren't the expected ones."""
    right = F.size(F.filter(F.map_keys(expected), lambda k: said[k] == expected[k]))
    same = F.array_sort(F.map_keys(said)) == F.array_sort(F.map_keys(expected))
    return F.when(same & (F.size(expected) > 0), right / F.size(expected))


def question_weight(grounded: Column, accuracy: Column, worth: Column) -> Column:
    """What a candidate question earns with an item: nothing unless grounded, half for that, half for the stances."""
    return F.when(grounded & accuracy.isNotNull(), (GROUNDING_SHARE + STANCE_SHARE * accuracy) * worth).otherwise(F.lit(0.0))


def question_utility(weights: DataFrame, worths: DataFrame, sizes: DataFrame, questions: int) -> DataFrame:
    """(task, utility): the best assignment's weight over the sum of the `questions` greatest worths, at most 1.

    `weights` has (task, cand, item, weight), none below 0, `worths` (task, item, worth). A task
    with another number of candidates than asked for earns 0.
    """
    top = Window.partitionBy("task").orderBy(F.desc("worth"), "item")
    most = worths.withColumn("n", F.row_number().over(top)).where(F.col("n") <= questions).groupBy("task").agg(F.sum("worth").alias("most"))
    if questions == 1:
        best = weights.groupBy("task").agg(F.max("weight").alias("sum"))
    else:
        best = weights.where("weight > 0").groupBy("task").agg(F.collect_list(F.struct("cand", "item", "weight")).alias("w")).select("task", greatest_sum(F.col("w")).alias("sum"))
    met = sizes.join(best, "task", "left").join(most, "task", "left")
    ok = (F.col("n_candidates") == questions) & (F.col("most") > 0)
    return met.select("task", F.when(ok, F.least(F.lit(1.0), F.coalesce("sum", F.lit(0.0)) / F.col("most"))).otherwise(F.lit(0.0)).alias("utility"))


@F.pandas_udf(T.DoubleType())
def _assigned(cands: pd.Series, items: pd.Series, weights: pd.Series) -> pd.Series:
    def best(cs, xs, ws) -> float | None:
        if cs is None:
            return None
        row, column = ({x: k for k, x in enumerate(dict.fromkeys(of))} for of in (cs, xs))
        table = [[0.0] * len(column) for _ in row]
        for c, x, w in zip(cs, xs, ws, strict=True):
            table[row[c]][column[x]] = max(table[row[c]][column[x]], float(w))
        return greatest_weight(table)

    return pd.Series([best(*x) for x in zip(cands, items, weights, strict=True)], dtype="float64")


def greatest_sum(pairs: Column) -> Column:
    """The greatest sum of weights of pairs (cand, item, weight above 0) that share no side; where no two pairs do it is the sum of all, and the row stays in the JVM, added up in the candidates' order."""
    pairs = F.array_sort(pairs)
    of = lambda name: F.transform(pairs, lambda p: p[name])
    apart = (F.size(F.array_distinct(of("cand"))) == F.size(pairs)) & (F.size(F.array_distinct(of("item"))) == F.size(pairs))
    each = [F.when(~apart, of(name)) for name in ("cand", "item", "weight")]
    return F.when(apart, F.aggregate(pairs, F.lit(0.0), lambda total, p: total + p["weight"])).otherwise(_assigned(*each))


def greatest_weight(weights: list[list[float]]) -> float:
    """The greatest sum of an assignment of rows to different columns, by shortest augmenting paths over dual prices."""
    if not weights or not weights[0]:
        return 0.0
    if len(weights) > len(weights[0]):
        weights = [list(c) for c in zip(*weights, strict=True)]
    rows, columns = len(weights), len(weights[0])
    top = max(map(max, weights))
    row_price, column_price = [0.0] * rows, [0.0] * columns
    owner = [-1] * columns
    for start in range(rows):
        reach, came, fixed = [float("inf")] * columns, [-1] * columns, [False] * columns
        row, last, at = start, -1, 0.0
        while True:
            for c in range(columns):
                if not fixed[c]:
                    cost = at + (top - weights[row][c]) - row_price[row] - column_price[c]
                    if cost < reach[c]:
                        reach[c], came[c] = cost, last
            last = min((c for c in range(columns) if not fixed[c]), key=reach.__getitem__)
            at, fixed[last] = reach[last], True
            if owner[last] < 0:
                break
            row = owner[last]
        row_price[start] += at
        for c in range(columns):
            if fixed[c] and c != last:
                row_price[owner[c]] += at - reach[c]
                column_price[c] -= at - reach[c]
        while last >= 0:
            before = came[last]
            owner[last] = start if before < 0 else owner[before]
            last = before
    return sum(weights[r][c] for c, r in enumerate(owner) if r >= 0)


def best_assignment(pairs: DataFrame, candidates: int = 3) -> DataFrame:
    """(task, n_pairs, correct, opportunities) of the best pairing of at most `candidates` candidates.

    `pairs` has the eligible (task, cand, item, correct, opportunities), cand from 0. The most
    pairs win, then the most correct stances, then the lowest list of (cand, item).
    """
    rows = pairs.groupBy("task").agg(F.collect_list(F.struct("cand", "item", "correct", "opportunities")).alias("pairs"))
    return rows.select("task", best_pairing(F.col("pairs"), candidates).alias("b")).select("task", "b.*")


def best_pairing(pairs: Column, candidates: int) -> Column:
    """best_assignment of an array of pairs, as a struct.

    Of a candidate's items only its best ones count, as many as there are candidates: if it has
    another one, one of these is free and at least as good.
    """
    ranked = lambda k: F.array_sort(F.transform(F.filter(pairs, lambda p: p["cand"] == k), lambda p: F.struct(
        (-p["correct"]).cast("long").alias("c"), p["item"].cast("int").alias("item"), p["opportunities"].cast("long").alias("o"), k.cast("int").alias("cand"))))
    once = lambda m: F.filter(m, lambda x, i: F.array_position(F.transform(m, lambda y: y["item"]), x["item"]) == i + 1)
    mine = F.transform(F.transform(F.sequence(F.lit(0), F.lit(candidates - 1)), ranked), lambda m: F.slice(once(m), 1, candidates))
    none = F.array().cast("array<struct<cand:int,item:int>>")
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), none.alias("list"), F.lit(0).cast("long").alias("o")))

    def more(state: Column, m: Column) -> Column:
        free = F.filter(m, lambda x: ~F.exists(state["list"], lambda p: p["item"] == x["item"]))
        return F.transform(free, lambda x: F.struct((state["n"] - 1).alias("n"), (state["c"] + x["c"]).alias("c"), F.concat(state["list"], F.array(F.struct(x["cand"].alias("cand"), x["item"].alias("item")))).alias("list"), (state["o"] + x["o"]).alias("o")))

    states = F.aggregate(mine, start, lambda states, m: F.concat(states, F.flatten(F.transform(states, lambda s: more(s, m)))))
    best = F.transform(F.array(F.array_min(states)), lambda b: F.struct((-b["n"]).alias("n_pairs"), (-b["c"]).alias("correct"), b["o"].alias("opportunities")))
    return best[0]


def public_profile_matches(candidate: Column, item: Column) -> Column:
    """Whether two structs of text say the same after normalisation, field by field."""
    out = F.lit(True)
    for f in PROFILE:
        out = out & (X.contract_text(candidate[f]) == X.contract_text(item[f]))
    return F.coalesce(out, F.lit(False))


def public_profile(decision: Column) -> Column:
    """A decision's texts as they are compared."""
    return F.struct(*[X.contract_text(decision[f]).alias(f) for f in PROFILE])
