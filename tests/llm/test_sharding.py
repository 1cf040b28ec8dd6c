import math
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from plenara.llm import sharding


def test_query_rows(spark, tmp_path):
    rows = [(i, f"text {i % 7} é", "x") for i in range(2000)] + [(5, None, "x"), (5, None, "x"), (None, "", "x"), (None, "", "x"), (6, "long " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sharding.op2_hash_tree_sharding(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, place = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 24)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert sharding.op2_hash_tree_sharding(spark, f"{tmp_path}/b").count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of strings."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed


def brute(key, weights, racks=2, shards=4):
    """Down the tree by the definition: at each level the child with the lowest draw of all shards below it."""
    draw = lambda s: -math.log(((spark_hash(key, f"shard {s}") >> 11) + 1) / (1 << 53)) / weights[s] if weights[s] else math.inf
    inside = list(range(len(weights)))
    for size in (racks * shards, shards, 1):
        children = {}
        for s in inside:
            children.setdefault(s // size, []).append(s)
        inside = min(children.values(), key=lambda below: min(map(draw, below)))
    return inside[0]


def shards_of(keys, tree):
    return [r.s for r in sharding.descended(keys, F.col("k"), tree, "s").orderBy(F.col("k").cast("long")).select("s").collect()]


def test_assignment_equals_brute_force(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    for weights in (*([1.0] * n for n in (1, 2, 7, 24, 25, 26, 33)), [0.0, 2.5, 1.0, 0.5, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0, 7.0]):
        assert shards_of(keys, sharding.layout(len(weights), weights)) == [brute(str(k), weights) for k in range(500)]


def test_shares_follow_weights_and_keys_move_only_into_what_gains(spark):
    keys = spark.range(60_000).select(F.col("id").cast("string").alias("k"))
    weights = [1.0] * 8 + [2.0] * 4 + [0.0] + [1.0] * 3
    changed = [*weights[:9], 4.0, *weights[10:]]
    a, b = (shards_of(keys, sharding.layout(16, w)) for w in (weights, changed))
    share = Counter(a)
    assert share[12] == 0 and all(abs(share[s] / 60_000 - weights[s] / sum(weights)) < 0.006 for s in range(16))
    moved = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert {y for _, y in moved} == {9} and abs(Counter(b)[9] / 60_000 - 4 / sum(changed)) < 0.006


def test_one_more_shard_takes_its_share_only_into_itself_at_every_count():
    """By the brute-force version, which the next shard counts hold against the operator's."""
    n, before = 1_500, [0] * 1_500
    for count in range(2, 66):
        now = [brute(str(k), [1.0] * count) for k in range(n)]
        moved = [y for x, y in zip(before, now, strict=True) if x != y]
        assert set(moved) == {count - 1} and abs(len(moved) / n - 1 / count) < 5 * (1 / (count * n)) ** 0.5, count
        before = now


def test_repeated_rows_are_not_numbered_in_one_task(spark):
    """Half of the rows are one id and text; they take slots of their own, part by part."""
    rows = spark.range(0, 40_000, numPartitions=16).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.sharded(rows, 24)
    assert got.columns[:2] == ["doc_id", "text"]
    shard = got.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m"), F.min("slot").alias("l")).collect()
    assert all(r.n == r.d == r.m + 1 and r.l == 0 for r in shard) and sum(r.n for r in shard) == 40_000
