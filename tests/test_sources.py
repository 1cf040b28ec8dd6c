"""Files in, files out: strict decoding, validation by mutation, saved runs, generators, publishing."""

import json

import pytest
from pyspark.sql import functions as F

from plenara.operators import generate, validate, views
from plenara.plans import findings, floors
from plenara.sources import jsonl, runs, schemas, sinks
from plenara.streaming.votes import windowed_stats

GOOD = {
    "session_id": "s1", "statements": [{"index": i, "text": f"t{i}"} for i in range(3)], "participants": ["a", "b", "c"], "votes": [[1, -1, None], [1, -1, 1], [-1, 1, -1]], "masked_cells": [[0, 2]],
    "held_out": {"0,2": 1}, "clusters": [0, 0, 1], "meta": {"k_anonymity": 5, "source": "x", "generator_family": "f", "synthetic": True},
}
MUTATIONS = {
    "duplicate participant": {"participants": ["a", "a", "c"]}, "blank participant": {"participants": ["a", " ", "c"]}, "statement index": {"statements": [{"index": i + 1, "text": "t"} for i in range(3)]},
    "row length": {"votes": [[1, -1, None], [1, -1], [-1, 1, -1]]}, "vote domain": {"votes": [[2, -1, None], [1, -1, 1], [-1, 1, -1]]}, "masked cell is visible": {"votes": [[1, -1, 1], [1, -1, 1], [-1, 1, -1]]},
    "masked cell bounds": {"masked_cells": [[0, 3]], "held_out": {"0,3": 1}}, "duplicate masked cell": {"masked_cells": [[0, 2], [0, 2]]}, "held-out cells": {"held_out": {"0,1": 1}}, "held-out vote": {"held_out": {"0,2": 3}},
    "cluster count": {"clusters": [0, 1]}, "row count": {"votes": [[1, -1, None], [1, -1, 1]]}, "session id": {"session_id": " "},
}


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_each_mutation_breaks_its_rule(spark, tmp_path):
    rows = [GOOD] + [GOOD | {"session_id": f"m{i}"} | m for i, m in enumerate(MUTATIONS.values())]
    got, errors = jsonl.decoded(jsonl.lines(spark, write(tmp_path / "a.jsonl", rows)), schemas.SNAPSHOT)
    assert errors.count() == 0
    broken = {}
    for r in validate.snapshot_violations(got).collect():
        broken.setdefault(r.session_id, set()).add(r.rule)
    assert "s1" not in broken
    for i, (rule, m) in enumerate(MUTATIONS.items()):
        assert rule in broken[m.get("session_id", f"m{i}")], rule


def test_decoding_is_strict(spark, tmp_path):
    text = json.dumps(GOOD)
    rows = [GOOD, "", text.replace('"clusters"', '"votes": [], "clusters"'), text.replace("[1, -1, null]", "[NaN, -1, null]"), text + " x", "[1]", json.dumps({k: v for k, v in GOOD.items() if k != "votes"}), text.replace('"t0"', '"t0 x"')]
    good, errors = jsonl.decoded(jsonl.lines(spark, write(tmp_path / "a.jsonl", rows)), schemas.SNAPSHOT)
    assert good.count() == 2 and errors.count() == 5
    assert jsonl.decoded(jsonl.lines(spark, write(tmp_path / "b.jsonl", [GOOD | {"extra": 1}])), schemas.SNAPSHOT, closed=True)[1].first().error == "unexpected extra"


def test_loading_masks_and_tasks_hide_answers(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [GOOD, GOOD | {"session_id": "s2", "clusters": [0, 0, 0]}, GOOD | {"session_id": "s3", "clusters": [0]}])
    good, errors = jsonl.load_snapshots(spark, path, masked_vote_count=3, min_cluster_count=2)
    row = good.collect()
    assert [r.session_id for r in row] == ["s1"] and row[0].masked_cells[0] == [0, 2] and len(row[0].held_out) == 3
    assert [e.error for e in errors.collect()] == ["s3: cluster count"]
    assert all(row[0].votes[int(k[0])][int(k[2])] is None for k in row[0].held_out)
    task = views.forecast_tasks(good).first()
    assert json.loads(task.answer) == row[0].held_out and "held_out" not in json.loads(task.snapshot) and json.loads(task.info)["masked_vote_count"] == 3
    prompts = {m: good.select(views.vote_prompt(m)).first()[0] for m in views.PROMPT_MODES}
    assert "p00: " in prompts["full"] and "t1" in prompts["full"] and "t1" not in prompts["matrix-only"] and "p00: " not in prompts["text-only"] and prompts["shuffled-text"] != prompts["full"]
    with pytest.raises(ValueError):
        views.vote_prompt("other")
    with pytest.raises(ValueError):
        jsonl.load_snapshots(spark, path, min_cluster_count=9)
    assert floors.snapshot_floors(good, masked=None, train=good).count() == 4


def human(session="h1", **changes):
    people = [f"p{i:03d}" for i in range(5)]
    votes = [[1, -1]] * 3 + [[0, None]] * 2
    stats = [{"commentIndex": 0, "agrees": 3, "disagrees": 0, "unsure": 2, "total": 5, "responded": 5, "extremity": None, "divisiveness": None}, {"commentIndex": 1, "agrees": 0, "disagrees": 3, "unsure": 0, "total": 3, "responded": 3, "extremity": None, "divisiveness": None}]
    meta = {
        "synthetic": False, "k_anonymity": 5, "source": "src", "seed": 1, "consent_scope": "research", "redistribution_rights_approved": True, "schema_version": "v2", "exporter_version": "1.2.3", "source_commit": "a" * 40,
        "privacy_review": {"attested": True, "reviewed_at": "2024-02-29", "checks": ["direct-identifiers", "free-text", "participant-pseudonyms"]},
    }
    row = {
        "session_id": session, "statements": [{"index": 0, "text": "More trees"}, {"index": 1, "text": "Fewer cars"}], "participants": people, "votes": votes, "masked_cells": [], "held_out": {},
        "clusters": [{"id": 0, "members": people, "member_indices": [0, 1, 2, 3, 4], "center": []}], "stats": {"comment": stats}, "meta": meta,
    }
    for k, v in changes.items():
        if isinstance(v, dict) and isinstance(row.get(k), dict):
            row[k] = row[k] | v
        else:
            row[k] = v
    return row


def test_intake_reports_and_keeps_the_first_of_each_session(spark, tmp_path):
    bad = {
        "direct identifier": human("b1", statements=[{"index": 0, "text": "Ask a@b.co"}, {"index": 1, "text": "x"}]), "reported counts": human("b2", stats={"comment": []}), "source commit": human("b3", meta={"source_commit": "xyz"}),
        "cluster center": human("b4", clusters=[{"id": 0, "members": [f"p{i:03d}" for i in range(5)], "member_indices": [0, 1, 2, 3, 4], "center": [0.5]}]), "pseudonyms": human("b5", participants=["Ann", "Bob", "Cy", "Di", "Ed"]),
    }
    a, b = write(tmp_path / "a.jsonl", [human(), *bad.values(), "{"]), write(tmp_path / "b.jsonl", [human(), human("h2")])
    accepted, manifest, errors = jsonl.ingest(spark, [a, b], "v2", "src")
    assert sorted(r.session_id for r in accepted.collect()) == ["h1", "h2"]
    assert {(r.source, r.line, r.session_id) for r in manifest.collect()} == {(0, 1, "h1"), (1, 2, "h2")}
    said = {(r.source, r.line): r.error for r in errors.collect()}
    for line, rule in enumerate(bad, start=2):
        assert rule in said[0, line]
    assert (0, 7) in said and said[1, 1] == "duplicate session_id: h1" and len(said) == 7


def test_publishing_is_all_or_nothing(tmp_path, monkeypatch):
    out, man = tmp_path / "o.jsonl", tmp_path / "m.json"
    digest = sinks.publish([{"b": 1, "a": "é"}], [{"row": 1}], str(out), str(man), "c")
    assert out.read_text() == '{"a":"é","b":1}\n' and json.loads(man.read_text())["output_sha256"] == digest
    real, calls = sinks.os.replace, []

    def failing(a, b):
        calls.append(b)
        if len(calls) == 2:
            raise OSError("disk")
        real(a, b)

    monkeypatch.setattr(sinks.os, "replace", failing)
    with pytest.raises(OSError):
        sinks.publish([{"new": 1}], [], str(out), str(man), "c")
    assert out.read_text() == '{"a":"é","b":1}\n' and len(list(tmp_path.iterdir())) == 2
    for rows, a, b in (([], out, man), ([{}], out, out), ([{}], tmp_path, man)):
        with pytest.raises(ValueError):
            sinks.publish(rows, [], str(a), str(b), "c")


def test_saved_runs_of_both_layouts(spark, tmp_path):
    saved, traced = tmp_path / "outputs/evals/env--m/r1", tmp_path / "outputs/evals/env--m/r2"
    for p in (saved, traced):
        p.mkdir(parents=True)
    (saved / "metadata.json").write_text(json.dumps({"env_id": "env", "model": "m", "num_examples": 2, "rollouts_per_example": 3, "env_args": {"prompt_mode": "full"}}))
    write(saved / "results.jsonl", [{"example_id": e, "reward": r, "error": None, "is_completed": True, "is_truncated": False, "answer": f"a{e}", "metrics": {"brier": 1 - r}} for e in (0, 1) for r in (1.0, 0.0, 1.0)])
    (traced / "config.toml").write_text('model = "m"\nnum_tasks = 1\nnum_rollouts = 2\n[env.taskset]\nid = "env"\n')
    trace = {"id": "t", "is_completed": True, "ok": True, "errors": [], "task": {"type": "T", "data": {"idx": 0, "answer": "a"}}, "rewards": {"x": {"score": 0.5, "weight": 2.0}, "y": {"score": 1.0, "weight": 0.25}}, "metrics": {"z": 3.0}}
    write(traced / "traces.jsonl", [{"id": "e1", "ok": True, "errors": [], "traces": [trace]}, {"id": "e2", "ok": False, "errors": ["x"], "traces": [trace]}])
    found = runs.discover(str(tmp_path))
    assert [p.name for p in found] == ["results.jsonl", "traces.jsonl"]
    rollouts, metrics, broken = runs.load(spark, found[0])
    stats = rollouts.agg(F.avg("reward"), F.stddev_pop("reward")).first()
    assert abs(stats[0] - 2 / 3) < 1e-12 and abs(stats[1] - 2**0.5 / 3) < 1e-12 and metrics.count() == 6 and broken.count() == 0
    rollouts, metrics, broken = runs.load(spark, found[1])
    assert {r.reward for r in rollouts.collect()} == {1.25} and metrics.count() == 6
    assert {r.rule for r in broken.collect()} == {"failed trace", "repeated trace id"}
    (traced / "config.toml").unlink()
    with pytest.raises(ValueError):
        runs.discover(str(tmp_path))


def test_generated_sessions_are_valid_and_repeatable(spark):
    made = generate.sessions(spark, 12, seed=5)
    assert validate.snapshot_violations(made).count() == 0
    rows = {r.session_id: r for r in made.collect()}
    again = {r.session_id: r for r in generate.sessions(spark, 4, seed=5, first=3).collect()}
    assert all(rows[k] == again[k] for k in again) and rows != {r.session_id: r for r in generate.sessions(spark, 12, seed=6).collect()}
    for r in rows.values():
        assert len(r.held_out) == 8 and min(r.clusters.count(c) for c in set(r.clusters)) >= 5 and len({s.text for s in r.statements}) == len(r.statements)
    scores = {r.baseline: r.brier for r in floors.snapshot_floors(made, masked=None, train=made).collect()}
    assert scores["neighbors"] < scores["column"] < scores["uniform"]


@pytest.fixture(scope="module")
def scenario_table(spark, tmp_path_factory):
    names = list(generate.TEMPLATES)
    path = str(tmp_path_factory.mktemp("s") / "scenarios")
    generate.scenarios(spark, names, 2, seed_base=9).select("json").write.text(path)
    return jsonl.load_scenarios(spark, path)


def test_generated_scenarios_are_valid_and_scored(spark, scenario_table):
    good, errors = scenario_table
    assert [r.error for r in errors.collect()] == [] and good.count() == 24
    suite = findings.reference_suite(good).first()
    assert suite.find_exact == 1 and suite.ask_exact == 1 and suite.find_longest < 1 and suite.ask_runner_up <= suite.ask_exact and suite.least_share == suite.most_share
    assert generate.canonical(generate.scenario("clinic-access", 3)) == generate.canonical(generate.scenario("clinic-access", 3))


def test_scenario_tasks_and_question_metrics(spark, scenario_table):
    good, _ = scenario_table
    for task in ("find", "ask"):
        row = findings.scenario_tasks(good, task, questions=2).first()
        answer = json.loads(row.answer)
        assert len(answer["questions"]) == 3 and json.loads(row.info)["task_label"] == task
        prompt = row.prompt[0].content
        assert all(q["document_text"] in prompt for q in answer["questions"]) and ("alternative_tradeoff_weights" in prompt) == (task == "ask")
        assert not any(json.dumps(q["target_stances"]) in prompt for q in answer["questions"])
    items = findings.items_of(good)
    asked = items.select("task", F.col("item").alias("cand"), "doc_id", "quote", "type", "question", "decision", "yes_choice", "related_evidence", "target_stances")
    right = findings.question_metrics(asked, items, 1.0, 3).first()
    assert all(abs(right[c] - 1) < 1e-9 for c in right.asDict() if c != "task")
    swapped = asked.withColumn("target_stances", F.transform_values("target_stances", lambda k, v: F.lit("pass"))).withColumn("question", F.lit("why?"))
    wrong = findings.question_metrics(swapped, items, 1.0, 3).first()
    assert wrong.utility == wrong.grounding_recall == 0 and wrong.evidence_match_recall == 1 and wrong.evidence_matched_stance_accuracy < 1
    assert findings.question_metrics(asked.where("cand < 2"), items, 1.0, 3).first().format_validity == 0
    with pytest.raises(ValueError):
        findings.scenario_tasks(good, "other")


def test_scenario_mutations(spark):
    base = generate.scenario("library-records", 4)

    def changed(f):
        s = json.loads(json.dumps(base))
        f(s)
        return s

    cases = {
        "scenario id": changed(lambda s: s.update(scenario_id="x-0")), "anchor not in document": changed(lambda s: s["planted_items"][0].update(anchor_quote="not there")),
        "decision value": changed(lambda s: s["planted_items"][0].update(decision_value=0.123)), "item question": changed(lambda s: s["planted_items"][0].update(canonical_question="why?")),
        "panel order": changed(lambda s: s["persona_panel"]["faction_ids"].reverse()), "faction values": changed(lambda s: s["factions"][0]["values"].update(safety=1.5)), "generated date": changed(lambda s: s["provenance"].update(generated_at="2024-02-30")),
    }
    for rule, s in cases.items():
        row = spark.createDataFrame([(json.dumps(s),)], "j string").select(F.from_json("j", schemas.SCENARIO).alias("v")).select("v.*")
        assert rule in {r.rule for r in validate.scenario_violations(row).collect()}, rule


def test_document_views(spark, scenario_table):
    good, _ = scenario_table
    full = views.document_view(good).first()
    assert len(full.visible_items) == 3
    few = views.document_view(good, planted_density=0.4).first()
    assert len(few.visible_items) == 1 and "contradiction" not in {x.type for x in few.visible_items}
    lost = {x.anchor_quote for x in full.planted_items} - {x.anchor_quote for x in few.visible_items}
    assert not any(q in d.text for q in lost for d in few.documents)
    short = views.document_view(good, docs_length=90)
    for r in short.collect():
        assert all(len(d.text) <= 91 for d in r.documents)
        assert all(any(x.anchor_quote in d.text for d in r.documents if d.doc_id == x.doc_id) for x in r.visible_items)


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), F.lit("a").alias("session"), (F.col("id") % 3).cast("int").alias("s"), (F.col("id") % 4 - 1).cast("int").alias("vote"))
    rows = rows.withColumn("vote", F.when(F.col("vote") < 2, F.col("vote")))
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_stats(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("stats").collect())) == sorted(map(tuple, windowed_stats(rows).collect()))
