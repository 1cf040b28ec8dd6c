import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from plenara.llm import bpe, linetree, quality  # noqa: E402
from tests.llm import test_decontam, test_linetree, test_neardup, test_quality  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(20)) for i in range(5)]
    texts = [None, "", "too short", "again and again " * 40]
    for i in range(40):
        body = [line(rnd.randrange(20, 60)) for _ in range(3)]
        if i % 4 == 0:
            body.insert(1, "this line stands in many of the documents here")
        if i % 9 == 0:
            body[0] += " " + items[i % 5][1].upper() + " end"
        texts.append("\n".join(body))
        if i % 3 == 0:
            texts.append(texts[-1].replace(" ", "  ", 1))
        if i % 5 == 0:
            w = texts[-1].split(" ")
            w[7] = "edited"
            texts.append(" ".join(w))
        if i % 6 == 0:
            texts.append(" ".join(x + "###" for x in texts[-1].split(" ")))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[6], None, None, 1)], items, [(i, 0 if t and "###" in t else 1, 0) for i, t in enumerate(texts)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items, labels = fixture()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert rules

    def good(text):
        n, chars, symbols, _, repeated = test_quality.brute(text)
        assert all(c.feature == "symbol_ratio" for r in rules for c in r)
        return n >= 50 and 2 * repeated <= n and not any(all((symbols / chars > c.threshold) == c.above for c in r) for r in rules)

    left = [(i, t) for i, t, *_ in rows if good(t)]
    gone = test_linetree.brute(left)
    def cut(i, t):
        """What line dedup leaves: all of a text that would lose more than half of its words."""
        parts = t.split("\n")
        lost = sum(len(parts[k].split()) for k in gone[i, t])
        return t if lost > len(t.split()) / 2 else "\n".join(x for k, x in enumerate(parts) if k not in gone[i, t])

    left = [(i, cut(i, t)) for i, t in left]
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    classes = test_neardup.classes([t for _, t in left])
    left = [r for k, r in enumerate(left) if classes[k] == k]
    found = test_decontam.brute([t for _, t in left], items)
    left = [r for r, (_, hit, _) in zip(left, found, strict=True) if not hit]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in out}
    assert sorted([r.doc_id for r in out], key=lambda i: (i is None, i or 0)) == [i for i, _ in left] and 10 < len(left) < len(rows) - 20
    v = bpe.vocabulary(bpe.default_path())
    for i, t in left:
        # a document whose id stands twice has the same text left, none
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[i].n_tokens * 4 == len(v.encode(t))
    assert linetree.MIN_DOCS == 3


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    rows, items, labels = fixture()
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("hits", F.lit(2)).withColumn("shard", F.lit(3))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0


def test_near_dedup_leaves_one_of_linked_texts_that_meet_in_no_sketch(spark):
    """Texts of which each ninth word differs share less than half of their shingles, but align at 0.88: one of each two goes."""
    rows = []
    for k in range(80):
        words = [f"w{k}x{i}" for i in range(300)]
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(f"v{k}x{i}" if i % 9 == 4 else w for i, w in enumerate(words)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 160, 2))
