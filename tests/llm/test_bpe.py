import hashlib

from pyspark.sql import functions as F

from plenara.llm import bpe

TEXTS = [
    None, "", " ", "plain words, plain words", "plain words, plain words", "<|endoftext|>a<|endoftext|><|endof", "é\u0085\x1c 　x", "a" * 3000, "a b" * 20_000,
    "😀" * 40 + "\t\n  \n ՘", "don't we'll I'M 12 34٣", "".join(map(chr, range(1, 1500))),
]


def test_ids_and_text_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_digests_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "two words"), (None, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op5_bpe_roundtrip(spark, str(tmp_path)).collect()}
    assert rows[None].n_tokens == 0 and rows[None].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[1].decoded_sha256 == hashlib.sha256(b"two words").hexdigest()
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.op5_bpe_roundtrip(spark, f"{tmp_path}/none").count() == 0


def test_null_and_unknown_ids_add_nothing(spark):
    docs = spark.createDataFrame([([5, None, -3, 10**6],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(docs, bpe.default_path()).collect()] == ["&", ""]


def test_digests_come_without_ids_and_texts(spark, tmp_path):
    """Neither ids nor texts go back to the JVM, and the digests are those of what the operator returns."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = bpe.op5_bpe_roundtrip(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array" not in plan and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    made = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "decoded#" not in made and "ids#" not in made
    full = bpe.encode(docs, bpe.default_path(), decoded="decoded")
    want = full.select("doc_id", F.size("ids").cast("long"), bpe.ids_digest(), F.sha2(F.col("decoded"), 256))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert [f.dataType for f in out.schema] == [f.dataType for f in want.schema]
