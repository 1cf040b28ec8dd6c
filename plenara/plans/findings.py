"""Scenario tasks end to end: edges between submitted findings or questions and planted items, their scores, and the model-free references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenara.functions import text as X
from plenara.operators import matching, prompts, spans, views

TYPES = ("ambiguity", "contradiction", "gap")


def _evidence(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(task, cand, item, side) where a candidate's quote is the expected one: candidates have (task, cand, doc_id, quote), expected (task, item, side, doc_id, quote, document)."""
    c = candidates.select("task", "cand", "doc_id", X.contract_tokens(F.col("quote")).alias("left"))
    e = expected.select("task", "item", "side", "doc_id", X.contract_tokens(F.col("quote")).alias("right"), X.contract_tokens(F.col("document")).alias("document"))
    pairs = c.join(e, ["task", "doc_id"])
    keys = ["task", "cand", "item", "side"]
    ratios = spans.span_ratios(spans.longest_common_spans(pairs, "left", "right", *keys)).join(pairs.select(*keys, X.contains_tokens(F.col("document"), F.col("left")).alias("contiguous")), keys)
    return ratios.where(matching.evidence_matches(F.col("overlap"), F.col("coverage"), F.col("precision"), F.col("contiguous"), F.lit(True))).select(*keys)


def finding_edges(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Edges of all stages. Both tables have task, doc_id, quote, type, related_evidence; candidates cand and diagnosis; items item, document and related_document.

    A contradiction is found from either of its sides; its other side must then be the related
    evidence. Other types take no related evidence.
    """
    first = items.select("task", "item", F.lit("own").alias("side"), "doc_id", "quote", "document")
    other = items.where("type = 'contradiction' AND related_evidence IS NOT NULL").select("task", "item", F.lit("reversed").alias("side"), "related_evidence.doc_id", "related_evidence.quote", F.col("related_document").alias("document"))
    primary = _evidence(candidates, first.unionByName(other))
    said = candidates.where("related_evidence IS NOT NULL").select("task", "cand", "related_evidence.doc_id", "related_evidence.quote")
    # the side of the related evidence is the other one
    turned = F.when(F.col("side") == "own", "reversed").otherwise("own").alias("side")
    related = _evidence(said, first.unionByName(other)).select("task", "cand", "item", turned, F.lit(True).alias("has_related"))
    kinds = candidates.select("task", "cand", F.col("type").alias("c_type"), X.is_yes_no_question(F.trim("diagnosis")).alias("asks"), F.col("related_evidence").isNull().alias("bare"))
    met = primary.join(kinds, ["task", "cand"]).join(items.select("task", "item", F.col("type").alias("i_type")), ["task", "item"]).join(related, ["task", "cand", "item", "side"], "left")
    typed, relation = F.col("c_type") == F.col("i_type"), F.when(F.col("i_type") == "contradiction", F.coalesce("has_related", F.lit(False))).otherwise(F.col("bare"))
    return met.groupBy("task", "cand", "item").agg(F.lit(True).alias("localized"), F.bool_or(typed).alias("typed"), F.bool_or(typed & F.col("asks")).alias("diagnosed"), F.bool_or(typed & F.col("asks") & relation).alias("related"))


def finding_scores(candidates: DataFrame, items: DataFrame) -> DataFrame:
    sizes = items.groupBy("task").agg(F.count("*").cast("int").alias("n_items")).join(candidates.groupBy("task").agg(F.count("*").cast("int").alias("n_candidates")), "task", "left").na.fill(0)
    return matching.stage_scores(finding_edges(candidates, items), sizes)


def items_of(scenarios: DataFrame, items: str = "planted_items") -> DataFrame:
    """Planted items as rows, with the documents they stand in."""
    text = lambda doc: F.get(F.filter("documents", lambda d: d["doc_id"] == doc), F.lit(0))["text"]
    rows = scenarios.select(F.col("scenario_id").alias("task"), "documents", F.posexplode(items).alias("item", "x"))
    return rows.select(
        "task", "item", "x.doc_id", F.col("x.anchor_quote").alias("quote"), "x.type", "x.related_evidence", text(F.col("x.doc_id")).alias("document"), text(F.col("x.related_evidence.doc_id")).alias("related_document"),
        F.col("x.canonical_question").alias("question"), "x.decision", "x.alternative_stances", "x.target_stances", F.col("x.canonical_yes_choice").alias("yes_choice"), "x.decision_value",
    )


def question_pairs(candidates: DataFrame, items: DataFrame, polarization: float) -> DataFrame:
    """Every candidate question (task, cand, doc_id, quote, type, question, decision, yes_choice, related_evidence, target_stances) with every item of its task.

    evidence: document, type, quote and related evidence are the item's after normalisation.
    grounded: so is the decision, and it is a yes/no question that says which outcome yes stands for.
    """
    return _met(candidates, items, polarization)


def _met(candidates: DataFrame, items: DataFrame, polarization: float, by_evidence: bool = False, *keep: str) -> DataFrame:
    """question_pairs, or those among them whose document, type and quote agree; texts are normalised before they meet. `keep` are more columns of the items."""
    quote, others = F.col("related_evidence.quote"), F.col("related_evidence.doc_id")
    seen = lambda side: [F.col("doc_id").alias(f"{side}_doc"), F.col("type").alias(f"{side}_type"), X.contract_text(F.col("quote")).alias(f"{side}_quote"), F.col("related_evidence").isNull().alias(f"{side}_bare"), others.alias(f"{side}_other"), X.contract_text(quote).alias(f"{side}_said"), matching.public_profile(F.col("decision")).alias(f"{side}_decision")]
    asks = X.is_yes_no_question(F.col("question")) & F.col("yes_choice").isin("anchor", "alternative")
    c = candidates.select("task", "cand", *seen("c"), asks.alias("asks"), "yes_choice", F.col("target_stances").alias("said"))
    worth = matching.attainable(F.col("decision_value"), matching.stance_disagreement(F.col("target_stances")), polarization)
    i = items.select("task", "item", *seen("i"), "alternative_stances", worth.alias("worth"), *keep)
    same = lambda *names: [F.col(f"c_{n}") == F.col(f"i_{n}") for n in names]
    all_of = lambda x, *more: x if not more else x & all_of(*more)
    place = all_of(*same("doc", "type", "quote"))
    met = c.withColumnRenamed("task", "__task").join(i, all_of(F.col("__task") == F.col("task"), place)) if by_evidence else c.join(i, "task")
    related = F.coalesce(all_of(*same("other", "said")), F.lit(False))
    evidence = F.coalesce(place & ((F.col("c_bare") & F.col("i_bare")) | related), F.lit(False))
    decided = F.coalesce(all_of(*[F.col(f"c_decision.{f}") == F.col(f"i_decision.{f}") for f in matching.PROFILE]), F.lit(False))
    expected = matching.oriented_stances(F.col("alternative_stances"), F.col("yes_choice"))
    accuracy = matching.stance_accuracy(F.col("said"), expected)
    opportunities = F.coalesce(F.size(expected), F.lit(0))
    out = met.select("task", "cand", "item", "worth", evidence.alias("evidence"), F.coalesce(evidence & F.col("asks") & decided, F.lit(False)).alias("grounded"), accuracy.alias("accuracy"), opportunities.cast("long").alias("opportunities"), *keep)
    return out.withColumn("correct", F.coalesce(F.round(F.col("accuracy") * F.col("opportunities")), F.lit(0.0)).cast("long"))


def question_weights(candidates: DataFrame, items: DataFrame, polarization: float) -> tuple[DataFrame, DataFrame]:
    """(weights, worths) for question_utility."""
    pairs = question_pairs(candidates, items, polarization)
    worth = matching.attainable(F.col("decision_value"), matching.stance_disagreement(F.col("target_stances")), polarization)
    return pairs.select("task", "cand", "item", matching.question_weight(F.col("grounded"), F.col("accuracy"), F.col("worth")).alias("weight")), items.select("task", "item", worth.alias("worth"))


def question_metrics(candidates: DataFrame, items: DataFrame, polarization: float, questions: int) -> DataFrame:
    """Utility and companion metrics of every task with items; all are 0 unless exactly `questions` candidates are given.

    `candidates` holds answers that keep the form; a task without any is malformed or empty.
    """
    worth = matching.attainable(F.col("decision_value"), matching.stance_disagreement(F.col("target_stances")), polarization)
    ranked = items.withColumn("worth", worth).withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("worth"), "doc_id", "quote")))
    of_items = ranked.groupBy("task").agg(F.max(F.size("target_stances")).alias("factions"), F.sum(F.when(F.col("r") <= questions, F.col("worth"))).alias("most"))
    said = candidates.groupBy("task").agg(F.count("*").cast("int").alias("n"))
    # only pairs whose evidence agrees count for any metric
    pairs = _met(candidates, ranked.withColumn("top", F.col("r") <= questions), polarization, True, "top").where("evidence")
    weight = matching.question_weight(F.col("grounded"), F.col("accuracy"), F.col("worth"))
    per_task = pairs.groupBy("task").agg(F.collect_list(F.struct("cand", "item", "correct", "opportunities", "grounded", "top", weight.alias("weight"))).alias("p"))
    best = lambda ok: matching.best_pairing(F.filter("p", ok), questions)
    found = per_task.select("task", matching.greatest_sum(F.filter("p", lambda p: p["weight"] > 0)).alias("best"), best(lambda p: p["grounded"]).alias("g"), matching.best_pairing(F.col("p"), questions).alias("e"), best(lambda p: p["top"]).alias("t"))
    out = of_items.join(said, "task", "left").withColumn("n_candidates", F.coalesce("n", F.lit(0))).join(found, "task", "left")
    ok, zero = F.col("n_candidates") == questions, F.lit(0.0)
    metric = lambda n, d: F.when(ok & (d > 0), F.coalesce(n, F.lit(0)) / d).otherwise(zero)
    k = F.lit(questions)
    utility = F.when(ok & (F.col("most") > 0), F.least(F.lit(1.0), F.coalesce("best", zero) / F.col("most"))).otherwise(zero)
    return out.select(
        "task", utility.alias("utility"), ok.cast("double").alias("format_validity"), metric(F.col("g.n_pairs"), k).alias("grounding_recall"), metric(F.col("g.correct"), k * F.col("factions")).alias("grounded_stance_recall"),
        metric(F.col("e.n_pairs"), k).alias("evidence_match_recall"), metric(F.col("e.correct"), F.col("e.opportunities")).alias("evidence_matched_stance_accuracy"), metric(F.col("t.n_pairs"), k).alias("top_selection_accuracy"),
    )


def scenario_tasks(scenarios: DataFrame, task: str = "find", questions: int = 1, polarization: float = 1.0, **difficulty) -> DataFrame:
    """Task rows (example_id, prompt, answer, info) of scenarios under a difficulty (document_view); `task` is find or ask.

    Items that a difficulty hides are in neither prompt nor answer; reference questions are in
    order of their worth. Tasks left with fewer items than `questions` drop out.
    """
    if task not in ("find", "ask"):
        raise ValueError("task must be find or ask")
    if not isinstance(questions, int) or questions < 1 or not 0 <= polarization <= 1:
        raise ValueError("questions must be positive and polarization between 0 and 1")
    seen = views.document_view(scenarios, **difficulty).where(F.size("visible_items") >= questions)
    text = lambda doc: F.get(F.filter("documents", lambda d: d["doc_id"] == doc), F.lit(0))["text"]
    worth = lambda x: matching.attainable(x["decision_value"], matching.stance_disagreement(x["target_stances"]), polarization)
    asked = lambda x: F.struct(
        (-worth(x)).alias("o1"), x["doc_id"].alias("o2"), x["anchor_quote"].alias("o3"),
        F.to_json(F.struct(
            x["alternative_stances"].alias("alternative_stances"), x["decision"].alias("decision"), x["decision_value"].alias("decision_value"), x["doc_id"].alias("doc_id"), text(x["doc_id"]).alias("document_text"), x["anchor_quote"].alias("quote"), x["canonical_question"].alias("question"),
            text(x["related_evidence"]["doc_id"]).alias("related_document_text"), x["related_evidence"].alias("related_evidence"), x["target_stances"].alias("target_stances"), x["type"].alias("type"), x["value_weights"].alias("value_weights"), x["canonical_yes_choice"].alias("yes_choice"),
        ), {"ignoreNullFields": "false"}).alias("json"),
    )
    found = lambda x: F.to_json(F.struct(x["canonical_question"].alias("diagnosis"), x["doc_id"].alias("doc_id"), text(x["doc_id"]).alias("document_text"), x["anchor_quote"].alias("quote"), text(x["related_evidence"]["doc_id"]).alias("related_document_text"), x["related_evidence"].alias("related_evidence"), x["type"].alias("type")), {"ignoreNullFields": "false"})
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    questions_json = listed(F.transform(F.array_sort(F.transform("visible_items", asked)), lambda x: x["json"]))
    answer = F.concat(F.lit('{"questions":'), questions_json, F.lit("}")) if task == "ask" else F.concat(F.lit('{"findings":'), listed(F.transform("visible_items", found)), F.lit(f',"question_count":{questions},"questions":'), questions_json, F.lit("}"))
    info = F.to_json(F.struct(
        F.lit(task == "find").alias("allow_combined_questions"), F.size("documents").alias("document_count"), F.lit(polarization).alias("panel_polarization"), F.size("visible_items").alias("plant_count"), F.lit(questions).alias("question_count"),
        "scenario_id", F.col("provenance.synthetic").alias("synthetic"), F.lit(task).alias("task_label"), F.col("provenance.template_set").alias("template_set"),
    ))
    prompt = prompts.ask_prompt(questions, polarization) if task == "ask" else prompts.find_prompt(questions)
    return seen.select(F.col("scenario_id").alias("example_id"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"), answer.alias("answer"), info.alias("info"))


def reference_suite(scenarios: DataFrame) -> DataFrame:
    """One row: mean scores of longest and hash-drawn sentences and of the exact answers, of single questions by rank, tie rate, least margin, class shares."""
    items = items_of(scenarios)
    sentences = scenarios.select(F.col("scenario_id").alias("task"), F.explode("documents").alias("d")).select("task", F.col("d.doc_id").alias("doc_id"), F.explode(X.sentences(F.col("d.text"))).alias("quote"))
    kinds = F.array(*map(F.lit, TYPES))

    def generic(*order) -> DataFrame:
        ranked = sentences.withColumn("cand", F.row_number().over(Window.partitionBy("task").orderBy(*order)) - 1).where("cand < 3")
        none = F.lit(None).cast("struct<doc_id:string,quote:string>")
        return ranked.select("task", "cand", "doc_id", "quote", F.get(kinds, F.col("cand")).alias("type"), F.lit("Should this documented rule be clarified?").alias("diagnosis"), none.alias("related_evidence"))

    exact = items.select("task", F.col("item").alias("cand"), "doc_id", "quote", "type", F.col("question").alias("diagnosis"), "related_evidence")
    mean_f1 = lambda c, name: finding_scores(c, items).agg(F.avg("f1").alias(name))
    longest = mean_f1(generic(F.desc(F.length("quote")), "doc_id", "quote"), "find_longest")
    drawn = mean_f1(generic(X.hash60(F.col("task"), F.col("doc_id"), F.col("quote")), "doc_id", "quote"), "find_random")
    asked = items.select("task", F.col("item").alias("cand"), "doc_id", "quote", "type", "question", "decision", "yes_choice", "related_evidence", "target_stances")
    weights, worths = question_weights(asked, items, 1.0)
    top = worths.groupBy("task").agg(F.max("worth").alias("most"))
    own = weights.groupBy("task", "cand").agg(F.max("weight").alias("w")).join(top, "task").withColumn("score", F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("w") / F.col("most"))).otherwise(F.lit(0.0)))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("w"), "cand")))
    asks = ranked.agg(F.avg("score").alias("ask_uniform"), F.avg(F.when(F.col("rank") == 2, F.col("score"))).alias("ask_runner_up"), F.avg(F.when(F.col("rank") == 1, F.col("score"))).alias("ask_exact"))
    two = worths.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("worth"), "item"))).groupBy("task").agg(F.max(F.when(F.col("rank") == 1, F.col("worth"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("worth"))).alias("b"))
    ties = two.agg(F.avg((F.abs(F.col("a") - F.col("b")) <= 1e-12).cast("double")).alias("tie_rate"), F.min(F.when(F.col("a") > 0, (F.col("a") - F.col("b")) / F.col("a")).otherwise(F.lit(0.0))).alias("least_margin"))
    share = items.groupBy("type").agg(F.count("*").alias("n")).agg((F.min("n") / F.sum("n")).alias("least_share"), (F.max("n") / F.sum("n")).alias("most_share"))
    out = drawn
    for part in (longest, mean_f1(exact, "find_exact"), asks, ties, share):
        out = out.crossJoin(part)  # single rows
    return out
