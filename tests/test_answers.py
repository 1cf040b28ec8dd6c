"""Answers, answer keys and lenient votes, decoded without Spark; study helpers and loaders of splits."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plenara.functions import panels
from plenara.functions import strict_json as J
from plenara.functions import text as X
from plenara.operators import prompts, study, validate
from plenara.sources import jsonl
from tests.test_sources import GOOD, human, write

FRAME = {"actor": "a", "action": " b ", "condition": "c", "anchor_outcome": "d", "alternative_outcome": "e"}
QUESTION = {
    "doc_id": "d1", "quote": "a rule", "type": "gap", "question": "Should it hold?", "decision": FRAME, "yes_choice": "anchor", "related_evidence": None, "target_stances": {"f1": "agree", "f2": "pass"},
}
FINDING = {"doc_id": "d1", "quote": "A rule, then", "type": "gap", "diagnosis": "Is it?", "related_evidence": None}


def said(**changes):
    return json.dumps({"questions": [QUESTION | changes]})


def test_questions_keep_their_form():
    got = J.questions(said())
    assert got == [QUESTION | {"decision": FRAME | {"action": "b"}}]
    bad = [
        {"question": "Hold it?"}, {"question": "Should it hold"}, {"question": " Should it hold?"}, {"type": "typo"}, {"yes_choice": "yes"}, {"quote": " "}, {"decision": {**FRAME, "more": "x"}},
        {"decision": FRAME | {"actor": ""}}, {"decision": FRAME | {"actor": "x" * 1001}}, {"related_evidence": {"doc_id": "d"}}, {"target_stances": {}}, {"target_stances": {"f": "maybe"}}, {"target_stances": {" ": "agree"}},
        {"more": 1}, {"doc_id": 3},
    ]
    assert [J.questions(said(**c)) for c in bad] == [None] * len(bad)
    both = json.dumps({"questions": [QUESTION], "findings": [FINDING]})
    assert J.questions(both) is None and J.questions(both, allow_findings=True) is not None
    assert J.questions(json.dumps({"questions": [QUESTION], "findings": [1]}), allow_findings=True) is None
    assert J.questions('{"questions": []}') == []


def test_findings_repeat_by_contract_tokens():
    of = lambda *f: J.findings(json.dumps({"findings": list(f)}))
    assert of(FINDING, FINDING | {"quote": "another"}) and of(FINDING, FINDING | {"quote": "a  RULE then!"}) is None
    assert of(FINDING, FINDING | {"quote": "a rule then", "doc_id": "d2"}) and of(FINDING | {"quote": "5 < 6"}, FINDING | {"quote": "5 > 6"})
    assert X.contract_tokens_of("Ａ −5 != ß, -7 !x") == ["a", "−", "5", "!=", "ss", "-", "7", "!", "x"]


def test_answer_keys_and_payloads():
    key = {"findings": [{"doc_id": 1, "anchor_quote": "q", "type": "gap", "canonical_question": "Is it?"}], "question_count": 2}
    (item,) = J.planted(json.dumps(key))
    assert (item["doc_id"], item["quote"], item["diagnosis"], item["document_text"]) == ("1", "q", "Is it?", "q")
    assert J.planted("{}") == J.planted("no key") == []
    assert [J.question_count(json.dumps({"question_count": x})) for x in (2, 0, True, 2.0, "2", None)] == [2, None, None, None, None, None]
    assert J.held_out_votes('{"1,2": 1, "2,3": 2, "3,4": true, "4,5": 1.0, "5,6": -1}') == {"1,2": 1, "5,6": -1}
    assert J.info_object('{"a": 1}') == {"a": 1} and J.info_object("[1]") == J.info_object("x") == J.info_object(None) == {}
    votes = [(1, 1), (1.0, 1), (True, None), ("-1", -1), (" 1", None), ({"agree": 0.1, "pass": 0.1}, 1), ({"1": 0, "-1": 2}, -1), ({"x": 1}, None), (None, None), ({"pass": 10**400, "agree": 0}, 1)]
    assert [J.lenient_vote(v) for v, _ in votes] == [w for _, w in votes]
    assert J.strict_vote({"agree": 0, "disagree": 2, "pass": 2}) == 0 and J.strict_vote({"agree": 1}) is None


def test_panels_and_seeds():
    assert panels.preference([1, -1], [0.5, 0.5]) == 0 and panels.preference([1], [0]) == 0
    assert panels.tradeoff([0.0, 0.0]) == 2.0**-52 and panels.tradeoff([1.0, -1.0]) == 1.0
    assert study.stable_seed(7, "x") == int.from_bytes(hashlib.sha256(b"7\0x").digest()[:8], "big")


def test_prompts_read_as_their_strings():
    """The shapes that answers must have, as the prompts show them."""
    for closing, shape in ((prompts.find_closing(1), prompts.FIND_SHAPE), (prompts.ASK_CLOSING, prompts.ASK_SHAPE)):
        assert shape in closing and shape.count("{") == shape.count("}") and "Am, Are, Can, Could" in "".join(closing)
    assert prompts.ASK_SHAPE.startswith('{"questions":[{"doc_id":"<document id>","quote":"<passage>","type":"ambiguity|contradiction|gap","question":"<specific clarifying question>","decision":{"actor"')
    assert prompts.FIND_SHAPE.endswith('"related_evidence":null|{"doc_id":"<conflicting document id>","quote":"<conflicting passage>"},"target_stances":{"<faction id>":"agree|disagree|pass"}}]}')


def test_study_helpers(spark):
    modes = spark.createDataFrame([("text-only",), (None,), ("zeta",), ("full",), ("alpha",)], "m string")
    assert [r.m for r in modes.orderBy(study.prompt_mode_order(F.col("m"))).collect()] == [None, "full", "text-only", "alpha", "zeta"]
    losses = spark.createDataFrame([("a", 0.1, 0.4), ("a", 0.3, 0.2)], "k string, loss double, ref double")
    got = study.skill_contributions(losses, ("k",), "loss", "ref").agg(F.avg("contribution")).first()[0]
    assert abs(got - (1 - 0.2 / 0.3)) < 1e-12
    metrics = spark.createDataFrame([("p", "brier", 0.1), ("q", "brier", 0.2), ("p", "f1", 0.5)], "env string, metric string, value double")
    found = {(r.env, r.metric): r.value for r in study.diagnostic_values(metrics, F.col("env") == "p").collect()}
    assert len(found) == 4 and abs(found["p", "brier_skill_vs_uniform"] - 0.7) < 1e-12


def test_marks_of_human_sessions_bring_their_rules(spark, tmp_path):
    mislabelled = human("h2", meta={"synthetic": True})
    path = write(tmp_path / "a.jsonl", [GOOD, human("h1"), mislabelled, human("h3", meta={"source": "other"})])
    good, errors = jsonl.load_snapshots(spark, path, masked_vote_count=2, human=("v2", "src"))
    assert sorted((r.session_id, len(r.held_out), len(r.clusters)) for r in good.collect()) == [("h1", 2, 5), ("s1", 2, 3)]
    assert {e.error for e in errors.collect()} == {"h2: synthetic", "h3: source"}
    alone, errors = jsonl.load_snapshots(spark, path)
    assert [r.session_id for r in alone.collect()] == ["s1"] and {e.error for e in errors.collect()} == {f"h{k}: human session" for k in (1, 2, 3)}
    said = spark.createDataFrame([(" Src_A ",), ("srca",), (None,)], "s string").select(jsonl.names_source(F.col("s"), "src-a").alias("n")).collect()
    assert [r.n for r in said] == [True, False, False]


def test_splits_and_clusters(spark, tmp_path):
    evaluated = write(tmp_path / "eval_synthetic.jsonl", [GOOD])
    assert jsonl.bundled_path(str(tmp_path), "eval") == evaluated and jsonl.train_split(spark, evaluated) is None
    train = write(tmp_path / "train_synthetic.jsonl", [GOOD])
    assert jsonl.train_split(spark, evaluated) == train and jsonl.train_split(spark, train) is None and jsonl.train_split(spark, train, evaluated) == evaluated
    with pytest.raises(ValueError):
        jsonl.bundled_path("x", "other")
    assert jsonl.load_snapshot_rows(spark, train).count() == 1
    with pytest.raises(ValueError):
        jsonl.load_snapshot_rows(spark, write(tmp_path / "c.jsonl", [GOOD | {"clusters": [0]}]))
    rows = [{"provenance": {"template_id": t}} for t in ("b", "a", "b")]
    path = write(tmp_path / "d.jsonl", [rows[0], "", rows[1], rows[2]])
    assert [tuple(r) for r in jsonl.template_clusters(spark, path).orderBy("task").collect()] == [(0, "b"), (1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        jsonl.template_clusters(spark, write(tmp_path / "e.jsonl", [rows[0], {"provenance": {}}]))


def test_lines_are_numbered_across_kinds_of_ends(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1\r\n\r2\r3\n\n4")
    (tmp_path / "b").write_bytes(b"5\r\n")
    got = jsonl.numbered_lines(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).collect()
    assert sorted((r.source, r.line, r.raw) for r in got) == [(0, 1, "5"), (1, 1, "1"), (1, 3, "2"), (1, 4, "3"), (1, 6, "4")]


def test_assigned_clusters(spark):
    frame = spark.createDataFrame([(["p", "q", "r"], [(7, [2, 0]), (9, [1])])], "participants array<string>, clusters array<struct<id:int,member_indices:array<int>>>")
    assert validate.assigned(frame).first().clusters == [7, 9, 7]
