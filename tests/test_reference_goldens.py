"""Values that the operators must give, and properties that hold whatever the data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plenara.functions import strict_json as J
from plenara.functions import text as X
from plenara.functions import votes as V
from plenara.operators import forecast, matching, matrix, study
from plenara.plans import floors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("s, n, want", [(0, 0, 1), (0, 1, 0), (1, 1, 1.4142135623730951), (0, 2, -0.5773502691896258), (2, 2, 1.7320508075688772), (3, 3, 2), (0, 4, -1.3416407864998738)])
def test_prop_test(spark, s, n, want):
    assert abs(one(spark, V.prop_test(F.col("s"), F.col("n")), s=s, n=n) - want) < 1e-9


@pytest.mark.parametrize("a, b, n, m, want", [(4, 0, 4, 4, 2.581988897471611), (1, 3, 5, 6, -0.8584645893961879), (2, 5, 6, 6, -1.6733200530681513), (0, 0, 0, 0, 0)])
def test_two_prop_test(spark, a, b, n, m, want):
    assert abs(one(spark, V.two_prop_test(*map(F.col, "abnm")), a=a, b=b, n=n, m=m) - want) < 1e-9


@pytest.mark.parametrize("r, want", [(-1.0, 0), (0.0, -1), (0.5, -0.9), (5.0, 0), (10.0, 1), (11.0, 0), (math.nan, 0)])
def test_rating_to_vote(spark, r, want):
    assert abs(one(spark, V.rating_to_vote(F.col("r")), r=r) - want) < 1e-9


def matrix_of(spark, rows, session="a"):
    return spark.createDataFrame([(session, p, s, v) for p, row in enumerate(rows) for s, v in enumerate(row)], matrix.CELL)


def test_comment_stats(spark):
    row = matrix.comment_stats(matrix_of(spark, [[v] for v in (1, -1, 0, None, 1, -1, 0)])).first()
    assert (row.agree, row.disagree, row["pass"], row.seen, row.pa, row.pd) == (2, 2, 2, 6, 0.375, 0.375)
    assert abs(row.pat + 0.37796447300922736) < 1e-9 and row.pat == row.pdt
    empty = matrix.comment_stats(matrix_of(spark, [[None]])).first()
    assert (empty.pa, empty.pat) == (0.5, 1)


def test_neighbors_by_hand(spark):
    visible = matrix_of(spark, [[1, -1, None], [1, -1, 1], [-1, 1, -1]])
    hidden = spark.createDataFrame([("a", 0, 2, 1)], matrix.CELL)
    row = forecast.nearest_participants(hidden, visible).first()
    total = 2.5 + 1e-6
    assert abs(row.pa - 1.5 / total) < 1e-12 and abs(row.pd - (0.5 + 1e-6) / total) < 1e-12
    lonely = forecast.nearest_participants(hidden, matrix_of(spark, [[None, None, None], [1, 1, 1], [1, 0, 0]])).first()
    assert abs(lonely.pa - 1.5 / 3.5) < 1e-12  # no row in common: the statement's smoothed shares
    with pytest.raises(ValueError):
        forecast.nearest_participants(hidden, visible, neighbors=0)


def brute_neighbors(votes, p, s):
    out = []
    for q, row in enumerate(votes):
        joint = [i for i, (a, b) in enumerate(zip(votes[p], row)) if i != s and a is not None and b is not None]
        if q != p and row[s] is not None and joint:
            m = sum(votes[p][i] == row[i] for i in joint)
            out.append((m / len(joint), m, -q, row[s]))
    return sorted(out, reverse=True)


def test_neighbors_equal_brute_force(spark):
    rnd = random.Random(2)
    votes = [[rnd.choice([1, -1, 0, None]) for _ in range(7)] for _ in range(9)]
    hidden = spark.createDataFrame([("a", p, s, 1) for p in range(4) for s in range(7) if votes[p][s] is None], matrix.CELL)
    got = {}
    for r in forecast.ranked_neighbors(hidden, matrix_of(spark, votes)).orderBy("rank").collect():
        got.setdefault((r.p, r.s), []).append((r.similarity, r.matches, -r.q, r.vote))
    for h in hidden.collect():
        assert got.get((h.p, h.s), []) == brute_neighbors(votes, h.p, h.s)


def test_masking_takes_listed_cells_first_and_is_repeatable(spark):
    full = matrix_of(spark, [[1, -1, 0, None], [0, 1, 1, -1]])
    first = spark.createDataFrame([("a", 1, 3, 1), ("a", 0, 3, 2)], "session string, p int, s int, at int")
    _, hidden = matrix.mask(full, 3, first=first)
    rows = sorted(hidden.collect(), key=lambda r: r["rank"])
    assert (rows[0].p, rows[0].s) == (1, 3) and len(rows) == 3
    assert {(r.p, r.s) for r in rows} == {(r.p, r.s) for r in matrix.mask(full.repartition(7), 3, first=first)[1].collect()}
    assert matrix.mask(full, -2)[1].count() == 0 and matrix.mask(full, 99)[1].count() == 7
    assert {(r.p, r.s) for r in matrix.mask(full, 3, seed="x")[1].collect()} != {(r.p, r.s) for r in matrix.mask(full, 3)[1].collect()}


def test_argmax_ties_and_uniform_floor(spark):
    assert one(spark, V.argmax_vote(F.col("a"), F.col("b"), F.col("c")), a=0.4, b=0.4, c=0.2) == 1
    assert one(spark, V.argmax_vote(F.col("a"), F.col("b"), F.col("c")), a=0.2, b=0.4, c=0.4) == 0
    full = matrix_of(spark, [[1, 1, -1], [1, 0, -1], [1, 1, 1]])
    rows = {r.baseline: r for r in floors.vote_floors(full, 4, train=full).collect()}
    assert abs(rows["uniform"].brier - 1 / 3) < 1e-12 and rows["uniform"].brier_skill_vs_uniform == 0 and rows["prior"].brier_skill_vs_prior == 0


@pytest.mark.parametrize("text, ok", [
    ('{"predictions": {"0,1": {"agree": 1, "disagree": 0, "pass": 0}}}', True), ('```json\n{"predictions": {" 0, 1": {"agree": 2, "disagree": 1.5, "pass": 0}}}\n```', True),
    ('{"predictions": {"0,1": {"agree": "1", "disagree": 0, "pass": 0}}}', False), ('{"predictions": {"0,1": {"agree": true, "disagree": 0, "pass": 0}}}', False),
    ('{"predictions": {"0,1": {"agree": NaN, "disagree": 0, "pass": 0}}}', False), ('{"predictions": {"0,1": {"agree": 0, "disagree": 0, "pass": 0}}}', False),
    ('{"predictions": {"0,1": {"agree": 1, "disagree": -1, "pass": 1}}}', False), ('{"predictions": {"0,1": {"agree": 1, "disagree": 0}}}', False),
    ('{"predictions": {"0,1": {"agree": 1, "disagree": 0, "pass": 0}}, "x": 1}', False), ('{"predictions": {"0,1": {"agree": 1, "agree": 1, "disagree": 0, "pass": 0}}}', False),
    ('{"predictions": {"0,1": {"agree": 1, "disagree": 0, "pass": 0}, "0, 1": {"agree": 1, "disagree": 0, "pass": 0}}}', False), ('{"predictions": {}} x', False), ("x {}", False),
    ("[" * 70 + "]" * 70, False), ('{"predictions": {"0,1": {"agree": 1e400, "disagree": 0, "pass": 0}}}', False), (" " * 70_000 + "{}", False), (None, False),
])
def test_forecast_contract(text, ok):
    assert (J.forecast(text) is not None) == ok


def test_answers_and_findings():
    finding = '{"doc_id": "d", "quote": "q q", "type": "gap", "diagnosis": "Is it?", "related_evidence": null}'
    assert len(J.findings(f'{{"findings": [{finding}]}}')) == 1
    assert J.findings(f'{{"findings": [{finding}, {finding.replace("q q", "Q  q")}]}}') is None
    assert J.findings(f'{{"findings": [{finding.replace("gap", "hole")}]}}') is None
    assert J.findings(f'{{"findings": [{finding}], "questions": []}}') is None and J.findings(f'{{"findings": [{finding}], "questions": []}}', 1) is not None
    deep = '{"a":' * 33 + "1" + "}" * 33
    assert J.answer_object(deep, J.ANSWER_CHARS, 32) is None and J.answer_object(deep, J.ANSWER_CHARS, 33) is not None
    assert J.depth('{"]]]": "[[["}') == 1


PII = [
    ("mail a.b+c@x-y.example.org now", "email"), ("请a@b.co写", "email"), ("0x" + "aB" * 20, "EVM address"), ("vitalik.eth.", "ENS name"), ("see www.example.org/x", "URL"), ("by @some_one", "social handle"),
    ("call 212-555-0199", "phone number"), ("+4915123456789", "phone number"), ("+44 20 7946 0958", "phone number"), ("Dr. Alice Example", "honorific-name"), ("请Dr Alice Example批准", "honorific-name"),
    ("at 192.168.0.1.", "IP address"), ("2001:db8::1", "IP address"),
    ("on 2024-01-02", None), ("version 1.2.3", None), ("a domain example.org", None), ("-1.25 and +0.5", None), ("bare @ sign", None), ("999.999.999.999", None), ("12:30:45", None), (None, None), ("", None),
]


def test_direct_identifiers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PII)], "i int, t string").select("i", X.direct_identifier(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: c for i, (_, c) in enumerate(PII)}


def test_identifier_scan_is_linear(spark):
    bad = ["a" * 200_000, "1" * 200_000, "a@" * 100_000, "1-" * 100_000, ":" * 200_000]
    assert spark.createDataFrame([(b,) for b in bad], "t string").select(X.direct_identifier(F.col("t"))).count() == 5


def test_text_predicates(spark):
    cases = {"Should x ?": True, "Is it so?": True, "is it so?": False, "Is it  so?": False, "Is it so??": False, "Isn't it?": False, "Is it? ": False}
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", X.is_yes_no_question(F.col("q")).alias("ok")).collect()
    assert {r.q: r.ok for r in rows} == cases
    dates = {"2024-02-29": True, "2023-02-29": False, "2024-2-9": False, "2024-01-01 ": False}
    rows = spark.createDataFrame([(d,) for d in dates], "d string").select("d", X.is_canonical_date(F.col("d")).alias("ok")).collect()
    assert {r.d: r.ok for r in rows} == dates
    assert one(spark, X.contract_tokens(F.col("t")), t="Ｆee >= 5% ! paid, -3 STRASSE") == ["fee", ">=", "5", "%", "!", "paid", "-", "3", "strasse"]
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, X.ngram_features(F.array(*map(F.lit, ["the", "a", "cat", "sat"]))), t="x") == ["the", "cat", "sat", "the::cat", "cat::sat"]


def test_matching_sizes_equal_augmenting_paths(spark):
    rnd = random.Random(6)
    edges, sizes = [], []
    for task in range(60):
        n, m = rnd.randrange(0, 6), rnd.choice([1, 2, 3, 4, 6])
        sizes.append((task, n, m))
        edges += [(task, c, i, True, rnd.random() < 0.6) for c in range(n) for i in range(m) if rnd.random() < 0.4]
    got = {r.task: (r.localized, r.typed) for r in matching.matching_size(spark.createDataFrame(edges, "task long, cand int, item int, localized boolean, typed boolean"), spark.createDataFrame(sizes, "task long, n_candidates int, n_items int"), "localized", "typed").collect()}
    for task, n, _ in sizes:
        mine = [e for e in edges if e[0] == task]
        assert got[task] == tuple(matching.pairs_off({c: [e[2] for e in mine if e[1] == c and e[k]] for c in range(n)}) for k in (3, 4))


def test_greatest_weight_equals_enumeration():
    from itertools import permutations

    rnd = random.Random(4)
    for _ in range(200):
        r, c = rnd.randrange(1, 5), rnd.randrange(1, 5)
        w = [[rnd.choice([0, rnd.random()]) for _ in range(c)] for _ in range(r)]
        wide = w if r <= c else [list(x) for x in zip(*w)]
        best = max(sum(wide[i][j] for i, j in enumerate(p)) for p in permutations(range(len(wide[0])), len(wide)))
        assert abs(matching.greatest_weight(w) - best) < 1e-9


def test_best_assignment(spark):
    pairs = [(1, 0, 0, 1, 3), (1, 0, 1, 2, 3), (1, 1, 1, 2, 4), (1, 2, 0, 0, 5), (2, 0, 1, 1, 1), (2, 1, 1, 1, 2)]
    got = {r.task: tuple(r)[1:] for r in matching.best_assignment(spark.createDataFrame([(*p[:3], p[3], p[4]) for p in pairs], "task long, cand int, item int, correct long, opportunities long")).collect()}
    assert got == {1: (2, 3, 7), 2: (1, 1, 1)}


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = {r.k: (round(r.holm_p, 9), r.family_size) for r in study.holm(spark.createDataFrame(list(enumerate(p)), "k int, p_value double"), order=("k",)).collect()}
    assert got == {3: (0.02, 4), 0: (0.03, 4), 2: (0.06, 4), 1: (0.06, 4)}


def test_draws_are_whole_and_shared_whatever_the_partitioning(spark):
    tasks = spark.createDataFrame([("s", t, t % 2) for t in range(6)] + [("u", 1, 0)], "stratum string, task long, cluster long")
    for cluster in (None, "cluster"):
        a = study.draws(tasks, 20, 3, cluster=cluster)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, study.draws(tasks.repartition(5), 20, 3, cluster=cluster).collect()))
        sizes = {(r.stratum, r.sample): r.n for r in a.groupBy("stratum", "sample").agg(F.sum("times").alias("n")).collect()}
        assert len(sizes) == 40 and set(sizes.values()) == {6, 1}


def test_newest_run_keeps_null_modes_apart(spark):
    runs = [("e", "m", None, 1, "a"), ("e", "m", None, 1, "b"), ("e", "m", "full", 5, "c"), ("e", "m", "full", 4, "d")]
    got = study.newest_runs(spark.createDataFrame(runs, "environment string, model string, prompt_mode string, ts long, run_id string")).collect()
    assert sorted(r.run_id for r in got) == ["b", "c"]
