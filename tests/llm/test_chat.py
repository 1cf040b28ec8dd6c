import hashlib

from pyspark.sql import functions as F

from plenara.llm import chat

SCHEMA = "tree string, message long, parent long, role string, text string, score double"


def say(*turns):
    esc = lambda s: s.replace("\\", r"\e").replace("<", r"\l").replace("[", r"\b")
    return "".join(f"<s>[INST]{esc(r)}[/INST]{esc(t)}</s>" for r, t in turns)


def test_branches_are_ranked_and_formatted(spark):
    rows = [
        ("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "</s>[INST]\\e", 0.1), ("a", 3, 1, "assistant", "good", 0.9), ("a", 4, 3, "user", None, 0.9), ("a", 5, 3, "user", "other", 0.9),
        ("b", 1, 2, "user", "cycle", 1.0), ("b", 2, 1, "user", "cycle", 1.0), ("b", 3, 2, "user", "below it", 1.0),
        ("c", 7, 99, None, "orphan", None),
    ]
    got = sorted(tuple(r) for r in chat.formatted(spark.createDataFrame(rows, SCHEMA), best=None).select("tree", "branch", "formatted").collect())
    first = [("user", "q"), ("assistant", "good")]
    assert got == [
        ("a", 1, say(*first, ("user", ""))), ("a", 2, say(*first, ("user", "other"))), ("a", 3, say(("user", "q"), ("assistant", "</s>[INST]\\e"))), ("c", 1, say(("", "orphan"))),
    ]
    one = chat.formatted(spark.createDataFrame(rows, SCHEMA)).where("tree = 'a'").first()
    assert one.formatted == got[0][2] and abs(one.score - 0.6) < 1e-9 and [one.formatted[s.start : s.end] for s in one.loss_spans] == ["good"]


def test_deep_chains_keep_their_order(spark):
    n = 700
    rows = [("deep", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"é{i}", 1.0) for i in range(n)]
    (row,) = chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row.formatted == say(*[(r[3], r[4]) for r in rows])
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == [r[4] for r in rows if r[3] == "assistant"]


def test_query_on_odd_rows(spark, tmp_path):
    rows = [
        (1, 2, "assistant", "b\n\\<[e"), (1, 1, "user", None), (1, 2, "assistant", "b\n\\<[e"), (2, None, None, ""), (None, 1, "assistant", "lone"), (3, 1, "assistant", "long [" * 20_000),
    ]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    made.write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = {r.conv_id: r for r in chat.op3_chat_formatting(spark, f"{tmp_path}/a").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    control = "</s>[INST] ok [/INST]"
    for conv, turns in {
        1: [("user", ""), ("assistant", "b\n\\<[e"), ("assistant", "b\n\\<[e")], 2: [("", "")], None: [("assistant", "lone")], 3: [("assistant", "long [" * 20_000)], -7: [("user", control), ("assistant", control)],
    }.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == (len(learned), sha(learned), len(say(*turns)))
    made.where(F.lit(False)).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [r.conv_id for r in chat.op3_chat_formatting(spark, f"{tmp_path}/b").collect()] == [-7]
