import random
import re

import numpy as np
from pyspark.sql import functions as F

from plenara.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\t", "é ñ ü 😀", "a b c d", "a b c a b c a b c", "x\nx\n\n\nx\r\nx", "#$ <a>|b&%*", "word " * 9000]
    for _ in range(60):
        out.append("".join(rnd.choice(["a", "b", "ccc", "é#"]) + rnd.choice([" ", "  ", "\n", "\x0b", "\r\n"]) for _ in range(rnd.randrange(80))))
    return out


def test_counts_equal_brute_force(spark):
    cases = texts()
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(cases)], "doc_id long, text string, kept string")
    rows = {r.doc_id: r for r in quality.apply_rules(docs, []).collect()}
    for i, t in enumerate(cases):
        got = rows[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute(t), repr(t)
        assert got.base_failed == (got.n_words < 50 or 100 * got.n_repeat_words > 50 * got.n_words) and got.kept == (not got.base_failed)


def test_list_finds_planted_rules_and_ignores_noise():
    rnd = np.random.default_rng(0)
    x = rnd.random((900, len(quality.FEATURES)))
    bad = (x[:, 1] > 0.8) & (x[:, 5] > 0.5) | (x[:, 4] < 0.1)
    aside = np.arange(900) % 3 == 0
    rules = quality.learn(x, bad, aside)
    said = np.zeros(900, bool)
    for r in rules:
        said |= quality.covers(r, x)
    assert (said == bad).mean() > 0.97 and (bad & said).sum() > 0.9 * bad.sum()
    assert quality.learn(x, np.zeros(900, bool), aside) == []
    noise = quality.learn(x, rnd.random(900) < 0.1, aside)
    assert sum(quality.covers(r, x).sum() for r in noise) < 60


def test_an_imprecise_rule_does_not_end_the_list():
    """The best first condition covers as many good rows as bad ones; what it covers is set aside, and the sharp rule is found."""
    rnd = np.random.default_rng(1)
    x = rnd.random((1200, len(quality.FEATURES)))
    sharp = x[:, 3] > 0.97
    bad = sharp | (x[:, 1] > 0.6) & (rnd.random(1200) < 0.5)
    said = np.zeros(1200, bool)
    for r in quality.learn(x, bad, np.arange(1200) % 3 == 0):
        said |= quality.covers(r, x)
    assert (said & sharp).sum() >= 0.9 * sharp.sum() and (said & ~bad).sum() <= 0.1 * said.sum()


def test_verdicts_on_whole_documents_equal_brute_force(spark):
    """The learned list, rule by rule in Python, over every document of the smallest table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality.op9_quality_rules(spark, "/root/testdata/sf0.001").collect():
        text = texts[r.doc_id] or ""
        words, chars, symbols, dup, repeated = brute(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
        share = lambda a, b: a / b if b else 0.0
        of = lambda pattern: share(len(re.findall(pattern, text)), chars)  # noqa: E731, B023
        values = (words, share(symbols, chars), share(dup, lines), share(repeated, words), share(chars, words), of("[A-Z]"), of("[0-9]"), of("[!?]"))
        hit = [k for k, rule in enumerate(rules) if all((values[quality.FEATURES.index(c.feature)] > c.threshold) == c.above for c in rule)]
        failed = words < 50 or 2 * repeated > words
        assert (r.base_failed, r.rule, r.kept) == (failed, hit[0] if hit else None, not failed and not hit)


def test_repeated_ids_are_one_row_of_the_sample(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i % 2, text + " #" * (i % 2 * 40)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == []  # two rows, too few for a rule


def test_case_expression_is_the_list(spark):
    rules = [(quality.Condition("symbol_ratio", True, 0.1),), (quality.Condition("n_words", False, 60.0), quality.Condition("upper_ratio", True, 0.5))]
    docs = spark.createDataFrame([(1, "# " * 60), (2, "AB " * 20 + " ".join(f"C{i}D" for i in range(40))), (3, " ".join(f"w{i}" for i in range(70)))], "doc_id long, text string")
    assert {r.doc_id: r.rule for r in quality.apply_rules(docs, rules).collect()} == {1: 0, 2: 1, 3: None}


def test_query_without_labels_and_on_empty_tables(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "x"), (1, good, "x"), (None, None, None)], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for name, d, lab in (("a", docs, labels), ("b", docs.where(F.lit(False)), labels.where(F.lit(False)))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert sorted((r.doc_id or 0, r.kept) for r in quality.op9_quality_rules(spark, f"{tmp_path}/a").collect()) == [(0, False), (1, True), (1, True)]
    assert quality.op9_quality_rules(spark, f"{tmp_path}/b").count() == 0
