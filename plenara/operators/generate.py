"""Seeded generators of sessions and scenarios, spread over partitions.

Every draw is a hash of (seed, what is drawn, where), so a row doesn't depend on the others, on
the partitioning or on a generator's state.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenara.functions.panels import preference, tradeoff
from plenara.functions.text import hash60
from plenara.operators.validate import DIMENSIONS, PASS_THRESHOLD, VOTE_RULE

K, MASKED, PASS_BELOW, NOISE, WOBBLE = 5, 8, 0.28, 0.12, 0.12

#: (text, dimension, polarity, bias) of the statements that sessions choose from.
BANK = tuple(
    (f"{verb} {what}", dimension, polarity, bias)
    for dimension, whats in zip(
        DIMENSIONS, (("evening opening hours", "phone bookings", "fee waivers"), ("yearly plan reviews", "local pilots", "flexible quotas"), ("long staff contracts", "existing routes", "fixed budgets"), ("public audits", "an appeals board", "published minutes"), ("night patrols", "safety training", "stricter inspections")), strict=True
    )
    for what in whats
    for verb, polarity, bias in (("We should expand", 1.0, 0.05), ("We should drop", -1.0, -0.05))
)


def _unit(*parts: Column) -> Column:
    return hash60(*parts) / float(1 << 60)


def sessions(spark: SparkSession, count: int, seed: int, family: str = "hash", first: int = 0, masked: int = MASKED, statements: tuple = BANK) -> DataFrame:
    """Nested snapshots of `count` sessions: clusters with opinions along five dimensions, noisy members, `masked` cells held out.

    Also returns `latent`, each cluster's own vote on each statement.
    """
    s, lit = F.lit(seed), F.lit
    base = spark.range(first, first + count).withColumn("session_id", F.concat(lit("synthetic-session-"), F.lpad(F.col("id").cast("string"), 6, "0")))
    d = lambda name, *more: hash60(s, F.col("id"), lit(name), *more)
    u = lambda name, *more: _unit(s, F.col("id"), lit(name), *more)
    base = base.withColumn("n_clusters", (2 + d("clusters") % 2).cast("int"))
    base = base.withColumn("n_people", (F.col("n_clusters") * K + d("people") % (21 - F.col("n_clusters") * K)).cast("int")).withColumn("n_statements", (8 + d("statements") % 9).cast("int"))
    bank = F.array(*[F.struct(lit(t).alias("text"), lit(k).alias("dimension"), lit(p).alias("polarity"), lit(b).alias("bias")) for t, k, p, b in statements])
    order = F.array_sort(F.transform(F.sequence(lit(0), lit(len(statements) - 1)), lambda i: F.struct(d("pick", i).alias("h"), i.alias("i"))))
    base = base.withColumn("chosen", F.transform(F.slice(order, 1, F.col("n_statements")), lambda x: F.get(bank, x["i"])))
    # every cluster gets K members, the rest draw one; then places are shuffled
    seats = F.array_sort(F.transform(F.sequence(lit(0), F.col("n_people") - 1), lambda i: F.struct(d("seat", i).alias("h"), F.when(i < F.col("n_clusters") * K, i % F.col("n_clusters")).otherwise((d("extra", i) % F.col("n_clusters")).cast("int")).alias("c"))))
    base = base.withColumn("clusters", F.transform(seats, lambda x: x["c"].cast("int")))

    def latent(c: Column, x: Column, i: Column) -> Column:
        score = (u("profile", c, x["dimension"]) * 2 - 1) * x["polarity"] + x["bias"] + (u("wobble", c, i) * 2 - 1) * WOBBLE
        return F.when(F.abs(score) < PASS_BELOW, lit(0)).when(score > 0, lit(1)).otherwise(lit(-1))

    base = base.withColumn("latent", F.transform(F.sequence(lit(0), F.col("n_clusters") - 1), lambda c: F.transform("chosen", lambda x, i: latent(c, x, i))))
    cell = lambda c, p, i: F.when(u("noise", p, i) < NOISE, (d("other", p, i) % 3 - 1).cast("int")).otherwise(F.get(F.get("latent", c), i))
    base = base.withColumn("full", F.transform("clusters", lambda c, p: F.transform("chosen", lambda x, i: cell(c, p, i))))
    every = F.flatten(F.transform("clusters", lambda c, p: F.transform("chosen", lambda x, i: F.struct(d("mask", p, i).alias("h"), p.alias("p"), i.alias("i")))))
    picked = F.array_sort(F.transform(F.slice(F.array_sort(every), 1, masked), lambda x: F.struct(x["p"].alias("p"), x["i"].alias("i"))))
    base = base.withColumn("picked", picked)
    gone = lambda p, i: F.exists("picked", lambda x: (x["p"] == p) & (x["i"] == i))
    return base.select(
        "session_id", F.transform("chosen", lambda x, i: F.struct(i.alias("index"), x["text"].alias("text"))).alias("statements"),
        F.transform("clusters", lambda c, p: F.concat("session_id", lit("-p"), p.cast("string"))).alias("participants"),
        F.transform("full", lambda row, p: F.transform(row, lambda v, i: F.when(~gone(p, i), v))).alias("votes"), F.transform("picked", lambda x: F.array(x["p"], x["i"])).alias("masked_cells"),
        F.map_from_entries(F.transform("picked", lambda x: F.struct(F.concat_ws(",", x["p"].cast("string"), x["i"].cast("string")), F.get(F.get("full", x["p"]), x["i"])))).alias("held_out"),
        "clusters", F.struct(lit(K).alias("k_anonymity"), lit(f"hash-generator:{family}:{seed}").alias("source"), lit(family).alias("generator_family"), lit(True).alias("synthetic")).alias("meta"), "latent",
    )


# --- scenarios -------------------------------------------------------------------------------

TYPES = ("ambiguity", "contradiction", "gap")
TEMPLATES = {
    f"{place}-{matter}": (place, matter)
    for place in ("library", "clinic", "harbour", "school")
    for matter in ("access", "records", "staffing")
}
_STEMS = {
    "ambiguity": ("The {place} may extend {matter} rules for urgent cases within a reasonable time.", "Should the {place} define a reasonable time for urgent {matter} cases?"),
    "contradiction": ("Every {matter} request at the {place} is decided by the duty manager alone.", "Should the duty manager of the {place} decide {matter} requests alone?"),
    "gap": ("Complaints about {matter} at the {place} are received at the front desk.", "Should the {place} name who answers complaints about {matter}?"),
}
_OPPOSED = "No {matter} request at the {place} is decided without the review board."
_PLAIN = ("The {place} opens at nine on weekdays.", "The notice board of the {place} lists all {matter} forms.", "Forms about {matter} are kept for two years.", "Visitors of the {place} sign the register.")


def _stance(values: dict, weights: dict) -> tuple[float, str]:
    p = preference([values[k] for k in DIMENSIONS], [weights[k] for k in DIMENSIONS])
    return p, "agree" if p >= PASS_THRESHOLD else "disagree" if p <= -PASS_THRESHOLD else "pass"


def scenario(template: str, seed: int, generated_at: str = "2024-01-01", polish: Callable[[str], str] | None = None, template_set: str = "train") -> dict:
    """One scenario that follows from its template and seed alone; `polish` may rewrite the plain sentences of its documents."""
    rnd, (place, matter) = random.Random(f"{template}:{seed}"), TEMPLATES[template]
    say = lambda s: s.format(place=place, matter=matter)
    factions = [{"faction_id": f"f{i}", "name": name, "summary": f"{name} of the {place}", "values": {k: round(rnd.uniform(-1, 1), 3) for k in DIMENSIONS}} for i, name in enumerate(("Staff", "Visitors", "Board", "Neighbours")[: rnd.choice([3, 4])])]
    texts: list[list[str]] = [[(polish or (lambda s: s))(say(s)) for s in rnd.sample(_PLAIN, 2)] for _ in range(4)]
    items = []
    for n, kind in enumerate(rnd.sample(TYPES, 3)):
        anchor, question = map(say, _STEMS[kind])
        while True:
            weights = {k: round(rnd.uniform(-1, 1), 3) for k in DIMENSIONS}
            stands = {f["faction_id"]: _stance(f["values"], weights) for f in factions}
            if {"agree", "disagree"} <= {s for _, s in stands.values()}:
                break
        alternative, choice = {k: s for k, (_, s) in stands.items()}, rnd.choice(["anchor", "alternative"])
        swap = {"agree": "disagree", "disagree": "agree", "pass": "pass"}
        texts[n].insert(rnd.randrange(3), anchor)
        related = None
        if kind == "contradiction":
            texts[3].insert(rnd.randrange(3), say(_OPPOSED))
            related = {"doc_id": "d3", "quote": say(_OPPOSED)}
        items.append({
            "plant_id": f"i{n}", "doc_id": f"d{n}", "anchor_quote": anchor, "type": kind, "canonical_question": question,
            "decision": {"actor": f"the {place}", "action": f"decides on {matter}", "condition": kind, "anchor_outcome": "the rule stands", "alternative_outcome": "the rule is clarified"},
            "value_weights": weights, "alternative_stances": alternative, "canonical_yes_choice": choice, "target_stances": {k: swap[s] for k, s in alternative.items()} if choice == "anchor" else alternative,
            "decision_value": tradeoff([p for p, _ in stands.values()]), "related_evidence": related,
        })
    distractors = [{"doc_id": f"d{n}", "anchor_quote": t, "reason": "a plain rule"} for n, lines in enumerate(texts) for t in lines if t not in {i["anchor_quote"] for i in items} and t != say(_OPPOSED)][:3]
    return {
        "scenario_id": f"{template}-{hashlib.sha256(f'{template}:{seed}'.encode()).hexdigest()[:12]}", "organization": {"name": f"{place.title()} of {matter}", "sector": place, "fictional": True}, "factions": factions,
        "documents": [{"doc_id": f"d{n}", "title": f"{place.title()} rules {n + 1}", "style": "memo", "text": " ".join(lines)} for n, lines in enumerate(texts)], "planted_items": items, "distractors": distractors,
        "persona_panel": {"vote_rule": VOTE_RULE, "pass_threshold": PASS_THRESHOLD, "faction_ids": [f["faction_id"] for f in factions]}, "human_feedback": None,
        "provenance": {"seed": seed, "template_id": template, "template_set": template_set, "generated_at": generated_at, "synthetic": True, "generation_mode": "template", "generator_family": "stems"},
    }


def canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def scenarios(spark: SparkSession, templates: list[str], repetitions: int, seed_base: int, generated_at: str = "2024-01-01", template_set: str = "train") -> DataFrame:
    """(scenario_id, json) of the grid of templates and repetitions; seed = base + place of the template * repetitions + repetition."""
    names, total = list(templates), len(templates) * repetitions

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scenario(names[i // repetitions], seed_base + i, generated_at, template_set=template_set) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m["scenario_id"] for m in made], pa.string()), pa.array(map(canonical, made), pa.string())], names=["scenario_id", "json"])

    return spark.range(total).mapInArrow(make, "scenario_id string, json string")


def splits(spark: SparkSession, train: list[str], held_out: list[str], repetitions: int, seed_base: int) -> DataFrame:
    """(split, scenario_id, json) of a training and a held-out split with templates of their own."""
    a = scenarios(spark, train, repetitions, seed_base).select(F.lit("train").alias("split"), "*")
    return a.unionByName(scenarios(spark, held_out, repetitions, seed_base + 1_000_000, template_set="heldout").select(F.lit("eval").alias("split"), "*"))


