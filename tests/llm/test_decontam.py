import hashlib
import os
import random
import subprocess
import sys

from plenara.llm import decontam

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string, n_words string"


def brute(texts, items, size=10):
    fold = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in t).translate({i: " " for i in range(128) if not chr(i).isalnum()}).split(" ") if w]
    out = []
    for t in texts:
        w, hit, found = fold(t or ""), set(), set()
        for i, x in items:
            v = fold(x or "")
            for k in range(max(1, len(v) - size + 1)) if v else []:
                part = v[k : k + size]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(str(i) if i is not None else "null")
        out.append((len(w), len(hit), sorted(found)))
    return out


def texts_and_items():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "B", "c1", "É", "é", "x y", "the", "The"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 9, 10, 14, 30])))) for i in range(12)]
    items += [(3, None), (None, "q r s"), (7, "--- !"), (7, items[7][1])]
    texts = [None, "", "…", "q-r_S!", "q r s" * 2000]
    for _ in range(40):
        parts = [word() for _ in range(rnd.randrange(30))]
        parts.insert(rnd.randrange(len(parts) + 1), (rnd.choice(items)[1] or "").replace(" ", rnd.choice([" ", ", ", "\n", "--"])))
        texts.append(" ".join(parts))
    return texts, items


def test_equals_brute_force_in_one_block_and_in_several(spark):
    texts, items = texts_and_items()
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(texts, items)
    parts = decontam.pieces(bench.selectExpr("string(item_id) AS id", "text AS t").where("t is not null"), 10, 5)
    dealt = [r[0] for b in decontam.blocks(parts, 12_000) for r in b.agg({"weight": "sum"}).collect()]
    assert 2 < len(dealt) and max(dealt) <= 12_000 and sum(dealt) == parts.agg({"weight": "sum"}).first()[0]
    for block in (1 << 30, 12_000):
        rows = {r.doc_id: r for r in decontam.contaminated_words(docs, bench, block_bytes=block).collect()}
        got = [(rows[i].n_words, sum(h["last"] - h["first"] + 1 for h in rows[i]["hits"]), rows[i]["items"]) for i in range(len(texts))]
        assert got == want


def test_spans_lie_in_the_original(spark):
    docs = spark.createDataFrame([(1, "So: Q--r, S. no"), (1, "So: Q--r, S. no"), (2, None)], "doc_id long, text string")
    found = decontam.hit_spans(decontam.contaminated_words(docs, spark.createDataFrame([(1, "q R s")], ITEMS)))
    assert sorted(("So: Q--r, S. no"[s["start"] : s["end"]] for r in found.collect() for s in r.spans)) == ["Q--r, S", "Q--r, S"]


def test_stage_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "q r s", 1), (2, None, 2), (3, "q r", 3)], "doc_id long, text string, hits int")
    kept = decontam.decontaminated(docs, spark.createDataFrame([(1, "q R s")], ITEMS))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = decontam.op8_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and not any(r.contaminated for r in rows) and {r.items_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}


def test_an_automaton_takes_what_it_is_weighed_at():
    rnd = random.Random(3)
    text = " ".join(f"w{rnd.randrange(30_000)}" for _ in range(60_000))
    code = f"""
import resource, random
from plenara.llm import decontam
rss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
rnd = random.Random(3)
text = " ".join(f"w{{rnd.randrange(30_000)}}" for _ in range(60_000))
before = rss()
made = decontam.Windows([("1", text)], 10)
print(rss() - before, made.scan(text)[0])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ).stdout.split(" ", 1)
    assert int(out[0]) < 1.2 * 10 * decontam._NODE * len(text.split())
    assert out[1].strip() == "[(0, 59999)]"
