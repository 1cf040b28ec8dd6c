import random
import time
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from plenara.llm import linetree as tree


def brute(rows):
    """The numbers of dropped lines of each (id, text), by the definition."""
    places = defaultdict(list)
    for i, text in set(rows):
        for no, line in enumerate(text.split("\n") if text is not None else []):
            m = tuple("<*>" if any(c in "0123456789" for c in t) else t for t in line.split())
            if m:
                places[m].append((i is None, i or 0, text, no))
    templates = defaultdict(list)
    for m, ps in places.items():
        lead, rest = m[:3], m[3:]
        n = min(8, len(rest))
        parts = [rest[len(rest) * i // n : len(rest) * (i + 1) // n] for i in range(n)]
        for open_ in combinations(range(n), min(n, 2, len(m) // 4)):
            fixed = tuple(None if i in open_ else p for i, p in enumerate(parts))
            templates[len(m), lead, fixed].append(m)
        if len(m) >= 50:
            templates["as it is", m].append(m)
    gone = defaultdict(set)
    for t, forms in templates.items():
        ps = sorted(((*p[:2], order(p[2]), p[3]), p) for m in forms for p in places[m])
        if len({p[2] for _, p in ps}) >= (2 if t[0] == "as it is" else 3):
            for _, (none, i, text, no) in ps[1:]:
                gone[None if none else i, text].add(no)
    return gone


def order(text):
    """Texts of one id follow each other by Spark's hash; the fixtures have no such texts that matter."""
    return text


def fixture():
    rnd = random.Random(8)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(rnd.randrange(4, 14)))
    rows = [(900, None), (901, ""), (902, "\n\n"), (903, "one two three\none two three"), (904, "x " * 5000)]
    for i in range(60):
        body = [prose() for _ in range(rnd.randrange(1, 5))]
        if i % 4 == 0:
            body.insert(0, "All rights are reserved by the owner")
        if i % 5 == 0:
            body.append(f"Posted on day {i} at {i * 3}:00 by  admin")
        if i % 6 == 0:
            body.append(f"user logged in from host {'qrstuvwxyz'[i // 6]}name over secure channel now and then again")
        if i % 20 == 0:
            body += [f"request served {prose()}", "twice the same two texts here"][: 1 + (i < 40)]
        rows.append((i, "\n".join(body)))
    rows += [(i + 200, rows[10][1]) for i in range(9)] + [rows[12], rows[12], (None, rows[9][1] + "\nAll rights are reserved by the owner")]
    return rows


def test_dropped_lines_equal_brute_force(spark):
    rows = fixture()
    want = brute(rows)
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, dropped string")
    got = tree.without_recurring_lines(docs, marks=True).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 30
    for (i, text), n in Counter(rows).items():
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i, text])
        mine = [g for g in got if g.doc_id == i and g.text == kept and g.dropped == sorted(want[i, text])]
        assert len(mine) >= n, (i, text)


def test_pipeline_columns_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame(fixture(), "doc_id long, text string").withColumn("n_lines", F.lit("kept"))
    assert tree.without_recurring_lines(docs).columns == docs.columns
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert tree.op7_line_templates(spark, str(tmp_path)).count() == 0


def dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.dropped for r in tree.without_recurring_lines(docs, marks=True).orderBy("doc_id").collect()]


def test_short_lines_and_lines_without_blanks_recur(spark):
    short = ["Les.", "And ornd.", "All rights reserved.", "这一行没有空格但在每个文本中都出现", " ", ""]
    texts = ["\n".join([*short, f"own {'abcd'[i]}"]) for i in range(4)]
    assert dropped(spark, texts) == [[], *[[0, 1, 2, 3]] * 3]
    assert dropped(spark, texts[:2]) == [[], []]


def test_a_template_counts_each_text_once(spark):
    refrain = "\n".join(f"we sing the same song of {x} once again today" for x in ("spring", "summer", "autumn"))
    assert dropped(spark, [refrain, "another text altogether"]) == [[], []]
    shared = [f"we sing the same song of {x} once again today" for x in ("peace", "hope")]
    assert dropped(spark, [refrain, shared[0]]) == [[], []]
    assert dropped(spark, [refrain, *shared]) == [[1, 2], [0], [0]]


def test_long_lines_recur_from_two_texts_on_and_copies_can_be_spared(spark):
    rnd = random.Random(2)
    long = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, other = long(60), long(40)
    texts = [f"{long(90)}\n{passage}\n{other}", f"{passage}\n{long(120)}\n{other}"]
    assert dropped(spark, texts) == [[], [0]]
    copies = [*texts, texts[0] + "\nand an end"]
    assert dropped(spark, copies)[2] == [0, 1, 2]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in tree.without_recurring_lines(docs, most=0.5).collect()}
    assert kept[2] == copies[2] and kept[1] == texts[1].split("\n", 1)[1].split("\n")[0]


def test_two_templates_of_one_leaf_and_edits_of_exact_ones(spark):
    a = [f"user logged in from host {x} over a secure channel" for x in ("qa", "qb", "qc")]
    b = [f"user logged in after reset {x} by the other team" for x in ("qd", "qe", "qf")]
    exact = "all rights of this work are reserved by its owner"
    edited = exact.replace("work", "text")
    texts = ["\n".join([x, y, exact]) for x, y in zip(a, b, strict=True)] + [edited]
    assert dropped(spark, texts) == [[], [0, 1, 2], [0, 1, 2], [0]]


def test_texts_of_very_many_lines(spark):
    rnd = random.Random(4)
    texts = ["\n".join([f"own {rnd.randrange(10**9):x}" + "pqrs"[i] for _ in range(50_000)] + ["the same last line"]) for i in range(3)]
    started = time.time()
    got = dropped(spark, texts)
    assert got[0] == [] or got[0][0] > 0
    assert [g[-1] for g in got[1:]] == [50_000, 50_000] and time.time() - started < 60
