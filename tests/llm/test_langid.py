import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenara.llm import langid

SYLLABLES = {"aa": ["ba", "lo", "mi"], "bb": ["tsch", "ung", "er"], "cc": ["ção", "ñe", "lo"]}


def corpus(n=240):
    rnd = random.Random(1)
    langs = list(SYLLABLES)
    return [(i, " ".join("".join(rnd.choice(SYLLABLES[langs[i % 3]]) for _ in range(3)) for _ in range(rnd.randrange(3, 60))), langs[i % 3]) for i in range(n)]


@pytest.fixture(scope="module")
def model():
    return langid.train([(lang, text) for i, text, lang in corpus() if zlib.crc32(str(i).encode()) % 3 != 1], steps=120)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x = langid.windows_of(b"some bytes to read" * 5)
    table, recurrent = rng.normal(0, 0.4, (257, 16)).astype(np.float32), rng.normal(0, 0.4, (8, 16)).astype(np.float32)
    g = rng.normal(0, 1, (langid.WINDOW, len(x), 8)).astype(np.float32)
    kept = []
    langid._states(x, table, recurrent, kept)
    d_table, d_recurrent = langid._back(g, x, kept, recurrent)
    for w, d, where in ((table, d_table, (ord("o"), 3)), (table, d_table, (ord("b"), 12)), (recurrent, d_recurrent, (2, 5)), (recurrent, d_recurrent, (1, 11))):
        step, old = 1e-2, w[where]
        w[where] = old + step
        up = (langid._states(x, table, recurrent) * g).sum()
        w[where] = old - step
        down = (langid._states(x, table, recurrent) * g).sum()
        w[where] = old
        assert abs((up - down) / (2 * step) - d[where]) < 0.02 * max(1, abs(d[where]))


def test_held_out_accuracy_and_pooling(model):
    out = [(t.encode(), lang) for i, t, lang in corpus() if zlib.crc32(str(i).encode()) % 3 == 1]
    p = langid.pooled([t for t, _ in out], model)
    assert np.mean([model.languages[k] == lang for k, (_, lang) in zip(p.argmax(1), out, strict=True)]) > 0.97
    one = max(out, key=lambda x: len(x[0]))[0]
    for raw in (one, one[:1], one[:97], one * 3):
        assert np.allclose(langid.pooled([b"x", raw, b""], model)[1], np.mean(brute(raw, model), axis=0), atol=1e-4)


def brute(raw, m):
    """Probabilities of each byte, byte after byte: both states begin MARGIN bytes before the core that the byte lies in."""
    out = []
    for core in range(0, len(raw), langid.CORE):
        a, b = max(0, core - langid.MARGIN), min(len(raw), core + langid.CORE + langid.MARGIN)
        both = []
        for d, seq in ((0, range(a, b)), (1, range(b - 1, a - 1, -1))):
            h, states = np.zeros(langid.STATE), {}
            for i in seq:
                v = np.tanh(m.inputs[d][raw[i]] + h @ m.recurrent[d])
                gate = 0.5 + 0.5 * v[: langid.STATE]
                h = (1 - gate) * h + gate * v[langid.STATE :]
                states[i] = h
            both.append(states)
        for i in range(core, min(len(raw), core + langid.CORE)):
            y = np.concatenate([both[0][i], both[1][i]]) @ m.output + m.bias
            out.append(np.exp(y - y.max()) / np.exp(y - y.max()).sum())
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(i, t, lang) for i, t, lang in corpus(90)] + [(500, None, "aa"), (501, "", "aa"), (502, "123 !?", None), (None, "balomi lolo", "bb"), (504, "é", None), (504, "é", None), (505, "balomi " * 20_000, None)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, lang string, score string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = {r.doc_id: r for r in langid.op1_language_id(spark, f"{tmp_path}/a").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert got[504].lang_pred in SYLLABLES and got[505].lang_pred == "aa" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(90))
    for name, d in (("b", docs.where(F.lit(False))), ("c", docs.withColumn("lang", F.lit(None).cast("string")))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert {r.lang_pred for r in langid.op1_language_id(spark, f"{tmp_path}/{name}").collect()} <= {"und"}


def test_runs_cover_every_byte(spark, model):
    docs = spark.createDataFrame([("balomi " * 30 + "tschunger " * 30,), (None,)], "text string")
    runs, none = [r.runs for r in langid.position_runs(docs, model).collect()]
    assert none == [] and runs[0].start == 0 and all(a.end == b.start for a, b in zip(runs, runs[1:])) and runs[-1].end == 510  # noqa: B905
    assert runs[0].lang == "aa" and runs[-1].lang == "bb"
