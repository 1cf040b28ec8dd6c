"""Validation that reports: every broken rule is a row (key, rule), and valid rows are what has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.functions import panels as P
from plenara.functions import text as X
from plenara.operators import matching, matrix

DIMENSIONS = ("access", "adaptability", "continuity", "oversight", "safety")
MAX_PARTICIPANTS, MAX_STATEMENTS, MAX_CELLS, MAX_CLUSTERS, LEAST_K = 10_000, 1_000, 1_000_000, 100, 5
PRIVACY_CHECKS = ("direct-identifiers", "participant-pseudonyms", "free-text")
#: Fixed value: a semantic version.
SEMVER = r"\A(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\z"
#: What scenarios may say of themselves.
VOTE_RULE, PASS_THRESHOLD = "value-composition-v2", 0.25
TEMPLATE_SETS, GENERATION_MODES = ("train", "heldout"), ("template", "operator-polished", "human")
DECISION_FIELDS, DECISION_CHARS = ("action", "actor", "alternative_outcome", "anchor_outcome", "condition"), 240
STANCES = ("agree", "disagree", "pass")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; a rule holds only where its Column is true, so a null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def valid(rows: DataFrame, broken: DataFrame, key: str) -> DataFrame:
    return rows.join(broken.select(key).distinct(), key, "left_anti")


def _unique(array: Column) -> Column:
    return F.size(array) == F.size(F.array_distinct(array))


def _filled(text: Column) -> Column:
    return text.isNotNull() & (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "")


def snapshot_violations(snapshots: DataFrame) -> DataFrame:
    """What is wrong with the dimensions of nested snapshots (clusters as one id for each participant)."""
    people, width = F.size("participants"), F.size("statements")
    cell = lambda c: F.concat_ws(",", c[0].cast("string"), c[1].cast("string"))
    inside = lambda c: (F.size(c) == 2) & (c[0] >= 0) & (c[0] < people) & (c[1] >= 0) & (c[1] < width)
    rules = {
        "session id": _filled(F.col("session_id")), "no participant": people > 0, "no statement": width > 0,
        "blank participant": F.forall("participants", _filled), "duplicate participant": _unique(F.col("participants")),
        "statement index": F.transform("statements", lambda s: s["index"].cast("int")) == F.sequence(F.lit(0), width - 1), "blank statement": F.forall("statements", lambda s: _filled(s["text"])),
        "row count": F.size("votes") == people, "row length": F.forall("votes", lambda r: F.size(r) == width),
        "vote domain": F.forall("votes", lambda r: F.forall(r, lambda v: v.isNull() | v.isin(-1, 0, 1))),
        "masked cell bounds": F.forall("masked_cells", inside), "duplicate masked cell": _unique(F.transform("masked_cells", cell)),
        "masked cell is visible": F.forall("masked_cells", lambda c: F.get(F.get("votes", c[0]), c[1]).isNull()),
        "held-out cells": F.array_sort(F.map_keys("held_out")) == F.array_sort(F.transform("masked_cells", cell)), "held-out vote": F.forall(F.map_values("held_out"), lambda v: v.isin(-1, 0, 1)),
        "cluster count": F.size("clusters") == people, "synthetic flag": F.col("meta.synthetic").isNotNull(),
    }
    return violations(snapshots, "session_id", rules)


def cluster_violations(snapshots: DataFrame, k: int = LEAST_K) -> DataFrame:
    """What is wrong with cluster objects (id, members, member_indices, center): sizes, agreement of names and places, exact partition, no centers."""
    every = F.flatten(F.transform("clusters", lambda c: c["member_indices"]))
    names = lambda c: F.transform(c["member_indices"], lambda i: F.get("participants", i))
    rules = {
        "clusters": F.size("clusters").between(1, MAX_CLUSTERS), "cluster ids": _unique(F.transform("clusters", lambda c: c["id"])),
        "cluster smaller than k": F.forall("clusters", lambda c: F.size(c["members"]) >= k), "members and places differ": F.forall("clusters", lambda c: c["members"] == names(c)),
        "clusters are no partition": F.array_sort(every) == F.sequence(F.lit(0), F.size("participants") - 1), "cluster center": F.forall("clusters", lambda c: F.size(c["center"]) == 0),
    }
    return violations(snapshots, "session_id", rules)


def pseudonym(place: Column) -> Column:
    """The name of the participant at a place: p and three digits, or more from place 1000 on."""
    number = place.cast("string")
    return F.concat(F.lit("p"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))


def governance_violations(snapshots: DataFrame, schema_version: str, source: str, k: int = LEAST_K) -> DataFrame:
    """What keeps human sessions from being published: bounds, pseudonyms, identifiers in texts, privacy review, provenance, statistics that don't follow from the votes."""
    people, width = F.size("participants"), F.size("statements")
    pseudonyms = F.transform(F.sequence(F.lit(0), people - 1), pseudonym)
    review = F.col("meta.privacy_review")
    rules = {
        "too many participants": people <= MAX_PARTICIPANTS, "too many statements": width <= MAX_STATEMENTS, "too many cells": people * width <= MAX_CELLS, "too few participants": people >= k,
        "pseudonyms": F.col("participants") == pseudonyms, "statement text": F.forall("statements", lambda s: s["text"] == F.trim(s["text"])),
        "human rows are unmasked": (F.size("masked_cells") == 0) & (F.size(F.map_keys("held_out")) == 0), "synthetic": F.col("meta.synthetic") == F.lit(False), "k-anonymity": F.col("meta.k_anonymity") >= k,
        "source": F.col("meta.source") == source, "schema version": F.col("meta.schema_version") == schema_version, "exporter version": F.col("meta.exporter_version").rlike(SEMVER),
        "source commit": F.col("meta.source_commit").rlike(r"\A[0-9a-f]{40}\z"), "rights": F.col("meta.redistribution_rights_approved") == F.lit(True), "consent": _filled(F.col("meta.consent_scope")),
        "privacy review": (review["attested"] == F.lit(True)) & X.is_canonical_date(review["reviewed_at"]) & (F.array_sort(review["checks"]) == F.array(*[F.lit(c) for c in sorted(PRIVACY_CHECKS)])),
    }
    broken = violations(snapshots, "session_id", rules)
    texts = snapshots.select("session_id", F.explode("statements").alias("s")).where(X.direct_identifier(F.col("s.text")).isNotNull())
    named = texts.select("session_id", F.lit("direct identifier").alias("rule")).distinct()
    return broken.unionByName(named)


def stats_violations(snapshots: DataFrame) -> DataFrame:
    """(session_id, rule, detail) where a session's reported counts differ from those of its votes."""
    said = snapshots.select("session_id", F.explode("stats.comment").alias("c")).select("session_id", F.col("c.commentIndex").alias("s"), F.struct("c.agrees", "c.disagrees", "c.unsure", "c.total", "c.responded").alias("said"))
    counted = matrix.comment_stats(matrix.cells(snapshots)).select(F.col("session").alias("session_id"), "s", F.struct(F.col("agree"), F.col("disagree"), F.col("pass"), F.col("seen"), F.col("seen")).alias("counted"))
    met = counted.join(said, ["session_id", "s"], "full_outer")
    longs = "struct<a:bigint,b:bigint,c:bigint,d:bigint,e:bigint>"
    return met.where(~F.col("said").cast(longs).eqNullSafe(F.col("counted").cast(longs))).select("session_id", F.lit("reported counts").alias("rule"), F.concat(F.lit("statement "), F.col("s").cast("string")).alias("detail"))


def preference(values: Column, weights: Column) -> Column:
    """A faction's stand on an issue: the weighted mean of its values over the five dimensions, summed in their fixed order."""
    top = sum((values[d] * weights[d] for d in DIMENSIONS[1:]), values[DIMENSIONS[0]] * weights[DIMENSIONS[0]])
    below = sum((F.abs(weights[d]) for d in DIMENSIONS[1:]), F.abs(weights[DIMENSIONS[0]]))
    return F.when(below > 0, top / below).otherwise(F.lit(0.0))


def stance(preference_: Column) -> Column:
    return F.when(preference_ >= 0.25, F.lit("agree")).when(preference_ <= -0.25, F.lit("disagree")).otherwise(F.lit("pass"))


def tradeoff_value(preferences: Column) -> Column:
    """What a decision is worth: four times the squared product of the root mean square and half the range, between 2^-52 and 1."""
    n = F.size(preferences)
    square = F.aggregate(preferences, F.lit(0.0), lambda s, x: s + x * x) / n
    half = (F.array_max(preferences) - F.array_min(preferences)) / 2
    return F.least(F.lit(1.0), F.greatest(F.lit(2.0**-52), 4 * F.pow(F.sqrt(square) * half, F.lit(2.0))))


def scenario_violations(scenarios: DataFrame) -> DataFrame:
    """What is wrong with scenarios: organisation, factions, documents, panel, planted items, distractors and provenance.

    Synthetic scenarios have a fictional organisation and a panel, and no human feedback; human
    ones the other way round (what their feedback must be is said by `feedback_violations`).
    """
    factions, docs, items = F.col("factions"), F.col("documents"), F.col("planted_items")
    ids = lambda c, f: F.transform(c, lambda x: x[f])
    vector = lambda v: F.array(*[v[d] for d in DIMENSIONS])
    bounded = lambda v: F.forall(vector(v), lambda x: x.isNotNull() & ~F.isnan(x) & x.between(-1, 1))
    text_of = lambda doc: F.get(F.filter(docs, lambda d: d["doc_id"] == doc), F.lit(0))["text"]
    there = lambda doc, quote: F.coalesce(F.contains(text_of(doc), quote), F.lit(False))
    stands = lambda x: F.transform(factions, lambda f: preference(f["values"], x["value_weights"]))
    expected = lambda x: F.map_from_arrays(ids(factions, "faction_id"), F.transform(stands(x), stance))
    entries = lambda m: F.array_sort(F.map_entries(m))
    plain = lambda q: _filled(q) & (q == X.collapsed(q))
    evidence = lambda x: x["related_evidence"]
    synthetic, fictional, mode = F.col("provenance.synthetic"), F.col("organization.fictional"), F.col("provenance.generation_mode")
    panel = F.col("persona_panel")
    related = F.filter(items, lambda x: x["type"] == "contradiction")
    at = lambda x: F.struct(x["doc_id"], x["same"])
    rules = {
        "scenario id": F.col("scenario_id") == X.scenario_id(F.col("provenance.template_id"), F.col("provenance.seed")),
        "organization": _filled(F.col("organization.name")) & _filled(F.col("organization.sector")) & (fictional == synthetic),
        "factions": F.size(factions).between(3, 5) & _unique(ids(factions, "faction_id")),
        "blank faction": F.forall(factions, lambda f: _filled(f["faction_id"]) & _filled(f["name"]) & _filled(f["summary"])),
        "faction values": F.forall(factions, lambda f: bounded(f["values"])),
        "documents": F.size(docs).between(3, 8) & _unique(ids(docs, "doc_id")),
        "blank document": F.forall(docs, lambda d: _filled(d["doc_id"]) & _filled(d["text"]) & _filled(d["title"]) & _filled(d["style"])),
        "panel": panel.isNotNull() == synthetic,
        "panel vote rule": panel.isNull() | (panel["vote_rule"] == VOTE_RULE),
        "panel order": panel.isNull() | (panel["faction_ids"] == ids(factions, "faction_id")),
        "panel threshold": panel.isNull() | (panel["pass_threshold"] == PASS_THRESHOLD),
        "human feedback": F.col("human_feedback").isNull() == synthetic,
        "planted items": (F.size(items) >= 3) & _unique(ids(items, "plant_id")) & (F.size(F.array_distinct(ids(items, "type"))) == 3),
        "item type": F.forall(items, lambda x: x["type"].isin("ambiguity", "contradiction", "gap")),
        "anchor not in document": F.forall(items, lambda x: there(x["doc_id"], x["anchor_quote"])),
        "anchor white space": F.forall(items, lambda x: plain(x["anchor_quote"])),
        "item question": F.forall(items, lambda x: X.is_yes_no_question(x["canonical_question"])),
        "item decision": F.forall(items, lambda x: F.forall(F.array(*[x["decision"][k] for k in DECISION_FIELDS]), lambda t: _filled(t) & (F.length(t) <= DECISION_CHARS))),
        "yes choice": F.forall(items, lambda x: x["canonical_yes_choice"].isin("anchor", "alternative")),
        "item weights": F.forall(items, lambda x: bounded(x["value_weights"]) & F.exists(vector(x["value_weights"]), lambda w: w != 0)),
        "alternative stances": F.forall(items, lambda x: entries(x["alternative_stances"]) == entries(expected(x))),
        "target stances": F.forall(items, lambda x: entries(x["target_stances"]) == entries(matching.oriented_stances(expected(x), x["canonical_yes_choice"]))),
        "decision value": ids(items, "decision_value") == F.col("__worths"),
        "related evidence": F.forall(items, lambda x: (x["type"] == "contradiction") == evidence(x).isNotNull()),
        "related evidence not in document": F.forall(items, lambda x: evidence(x).isNull() | there(evidence(x)["doc_id"], evidence(x)["quote"])),
        "related evidence in the same document": F.forall(related, lambda x: evidence(x).isNull() | (evidence(x)["doc_id"] != x["doc_id"])),
        "factions agree": F.forall(items, lambda x: F.array_contains(F.map_values(x["target_stances"]), "agree") & F.array_contains(F.map_values(x["target_stances"]), "disagree")),
        "no distractor": F.size("distractors") > 0, "distractor reason": F.forall("distractors", lambda x: _filled(x["reason"])),
        "distractor not in document": F.forall("distractors", lambda x: there(x["doc_id"], x["anchor_quote"])),
        "distractor white space": F.forall("distractors", lambda x: plain(x["anchor_quote"])),
        "duplicate anchor": _unique(F.transform("__anchors", at)), "duplicate question": _unique(F.col("__questions")),
        "related evidence is an item": F.size(F.array_intersect(F.transform("__related", at), F.transform("__anchors", at))) == 0,
        "distractor is an item": F.size(F.array_intersect(ids(F.col("__distractors"), "same"), ids(F.col("__anchors"), "same"))) == 0,
        "distractor is related evidence": F.size(F.array_intersect(F.transform("__distractors", at), F.transform("__related", at))) == 0,
        "generated date": X.is_canonical_date(F.col("provenance.generated_at")), "template set": F.col("provenance.template_set").isin(*TEMPLATE_SETS),
        "generation mode": F.when(synthetic, mode.isin(*GENERATION_MODES[:2])).otherwise(mode == "human"), "generator family": _filled(F.col("provenance.generator_family")),
    }
    return violations(_identified(scenarios), "scenario_id", rules)


def _identified(scenarios: DataFrame) -> DataFrame:
    """`scenarios` with the worth of each item and the identities of anchors, related evidence, distractors and questions.

    The Unicode steps take columns of texts, so lists go through them joined by a sign that no text has.
    """
    values = F.transform("factions", lambda f: F.array(*[f["values"][d] for d in DIMENSIONS]))
    weights = F.transform("planted_items", lambda x: F.array(*[x["value_weights"][d] for d in DIMENSIONS]))
    out = scenarios.withColumn("__worths", P.worths(values, weights))
    related = F.filter("planted_items", lambda x: (x["type"] == "contradiction") & x["related_evidence"].isNotNull())
    quotes = {
        "__anchors": ("planted_items", lambda x: x["doc_id"], lambda x: x["anchor_quote"]), "__distractors": ("distractors", lambda x: x["doc_id"], lambda x: x["anchor_quote"]),
        "__related": (related, lambda x: x["related_evidence"]["doc_id"], lambda x: x["related_evidence"]["quote"]),
    }
    for name, (rows, doc, quote) in quotes.items():
        each = F.split(X.anchor_identity(F.array_join(F.transform(rows, quote), _BETWEEN, "")), _BETWEEN)
        out = out.withColumn(name, F.arrays_zip(F.transform(rows, doc).alias("doc_id"), F.transform(each, lambda t: F.trim(t)).alias("same")))
        out = out.withColumn(name, F.when(F.size(rows) > 0, F.col(name)).otherwise(F.array().cast("array<struct<doc_id:string,same:string>>")))
    asked = F.transform("planted_items", lambda x: x["canonical_question"])
    return out.withColumn("__questions", F.split(X.question_fingerprint(F.array_join(asked, _BETWEEN, "")), _BETWEEN))


_BETWEEN = "\u0002"


def feedback_violations(scenarios: DataFrame, schema: str, schema_version: str, source: str, k: int = LEAST_K) -> DataFrame:
    """(scenario_id, rule) where the human feedback of a human scenario isn't a session that may be published."""
    read = scenarios.where("human_feedback IS NOT NULL").select("scenario_id", F.from_json("human_feedback", schema, {"mode": "FAILFAST"}).alias("v"))
    rows = read.select("scenario_id", "v.*").withColumn("session_id", F.col("scenario_id")).drop("scenario_id")
    return human_violations(rows, schema_version, source, k).withColumnRenamed("session_id", "scenario_id")


def human_violations(snapshots: DataFrame, schema_version: str, source: str, k: int = LEAST_K) -> DataFrame:
    """(session_id, rule): all that keeps human sessions (clusters as objects) from being used."""
    plain = snapshots.withColumn("clusters", F.transform("participants", lambda p: F.lit(0)))
    out = snapshot_violations(plain).unionByName(cluster_violations(snapshots, k)).unionByName(governance_violations(snapshots, schema_version, source, k))
    return out.unionByName(stats_violations(snapshots).select("session_id", "rule"))


def assigned(snapshots: DataFrame) -> DataFrame:
    """Sessions with cluster objects as sessions with one cluster id for each participant."""
    of = lambda p, i: F.get(F.filter("clusters", lambda c: F.array_contains(c["member_indices"], i)), F.lit(0))["id"]
    return snapshots.withColumn("clusters", F.transform("participants", of))
