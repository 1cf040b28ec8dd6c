"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows, once in each direction. A unit keeps or renews its
state through one gate, as in the light gated units of the literature; both states at a byte
give that byte's language probabilities, and a document's are the mean over all its bytes. Windows
overlap when texts are read: each of CORE bytes is read with MARGIN bytes on both sides, which warm
the states up, so that no byte is labelled at the border of what the network sees. It is trained
in numpy by backpropagation through time on a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.llm.common import add_columns, table

#: Training sample (parameters of `fit`): documents of each language at most, code points taken of each document at most.
PER_LANGUAGE, SAMPLE_CHARS = 400, 1500
#: Bytes of a window in training; of a window's core and of each of its margins in reading.
WINDOW, CORE, MARGIN = 64, 96, 16
STATE, PAD = 8, 256
STEPS, BATCH, RATE = 500, 256, 0.02
BLOCK = 1024
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class Model:
    """Weights of both directions (input table, recurrent matrix), and of the output."""

    languages: list[str]
    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def windows_of(raw: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled up with PAD."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def overlapping(raw: bytes) -> np.ndarray:
    """The bytes in rows of MARGIN + CORE + MARGIN, each CORE further on; PAD stands before the first and after the last byte."""
    n = -(-len(raw) // CORE)
    out = np.full(max(1, n) * CORE + 2 * MARGIN, PAD, np.int16)
    out[MARGIN : MARGIN + len(raw)] = np.frombuffer(raw, np.uint8)
    if not n:
        return out.reshape(1, -1)[:0]
    return np.lib.stride_tricks.sliding_window_view(out, CORE + 2 * MARGIN)[::CORE]


def _states(x: np.ndarray, table_: np.ndarray, recurrent: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte of the windows x (rows), as (byte, window, unit). A pad leaves the state as it is."""
    n, size = x.shape[0], recurrent.shape[0]
    out = np.empty((x.shape[1], n, size), np.float32)
    h = np.zeros((n, size), np.float32)
    columns = np.ascontiguousarray(x.T)
    a = np.empty((n, 2 * size), np.float32)
    for t, column in enumerate(columns):
        np.take(table_, column, axis=0, out=a, mode="clip")
        a += h @ recurrent
        np.tanh(a, out=a)
        z = a[:, :size] * np.float32(0.5)
        z += np.float32(0.5)
        z *= a[:, size:] - h
        if keep is not None:
            keep.append((a.copy(), h))
        h = h + z
        out[t] = h
    return out


def _both(x: np.ndarray, m: Model, keep: tuple | None = None) -> np.ndarray:
    forth = _states(x, m.inputs[0], m.recurrent[0], keep and keep[0])
    back = _states(x[:, ::-1], m.inputs[1], m.recurrent[1], keep and keep[1])[::-1]
    return np.concatenate([forth, back], axis=2)


def position_probabilities(x: np.ndarray, m: Model) -> np.ndarray:
    """Language probabilities of each byte, as (byte, window, language)."""
    y = _both(x, m) @ m.output + m.bias
    y -= y.max(axis=2, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=2, keepdims=True)
    return y


def _back(g: np.ndarray, x: np.ndarray, kept: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's input table and recurrent matrix, from those of its states (byte, window, unit)."""
    size = recurrent.shape[0]
    through = np.zeros_like(g[0])
    at, d_recurrent = np.empty((len(kept), g.shape[1], 2 * size), np.float32), np.zeros_like(recurrent)
    for t in range(len(kept) - 1, -1, -1):
        a, h = kept[t]
        s, c = a[:, :size], a[:, size:]
        z = 0.5 + 0.5 * s
        now = g[t] + through
        at[t, :, :size] = 0.5 * now * (c - h) * (1 - s * s)
        at[t, :, size:] = now * z * (1 - c * c)
        d_recurrent += h.T @ at[t]
        through = now * (1 - z) + at[t] @ recurrent.T
    where = x.T.ravel()
    flat = at.reshape(-1, 2 * size)
    d_table = np.stack([np.bincount(where, flat[:, k], PAD + 1) for k in range(2 * size)], axis=1).astype(np.float32)
    d_table[PAD] = 0
    return d_table, d_recurrent


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> Model | None:
    """A model of (language, text) samples; None if there is nothing to learn from.

    Languages are drawn equally often, whatever their number of samples.
    """
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in samples:
        if text and any(c.isalpha() for c in text):
            by.setdefault(lang, []).append(windows_of(text.encode("utf-8", "replace")))
    if not by:
        return None
    languages = sorted(by)
    pools = [np.concatenate(by[k]) for k in languages]
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    tables = [normal(PAD + 1, 2 * STATE, scale=0.3) for _ in range(2)]
    for t in tables:
        t[PAD, :STATE], t[PAD, STATE:] = -30, 0  # the gate stays shut
    weights = [*tables, *(normal(STATE, 2 * STATE, scale=0.3) for _ in range(2)), normal(2 * STATE, len(languages), scale=0.3), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        said = rng.integers(0, len(languages), BATCH)
        x = np.stack([pools[k][rng.integers(0, len(pools[k]))] for k in said])
        m = Model(languages, (weights[0], weights[1]), (weights[2], weights[3]), weights[4], weights[5])
        kept: tuple[list, list] = ([], [])
        h = _both(x, m, kept)
        y = h @ m.output + m.bias
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        real = (x.T < PAD).astype(np.float32)
        y[:, np.arange(BATCH), said] -= 1
        y *= (real / real.sum())[:, :, None]
        d_h = y @ m.output.T
        forth, back = d_h[:, :, :STATE], d_h[::-1, :, STATE:]
        t0, r0 = _back(forth, x, kept[0], m.recurrent[0])
        t1, r1 = _back(back, x[:, ::-1], kept[1], m.recurrent[1])
        flat = h.reshape(-1, 2 * STATE)
        rate = RATE * 0.5 * (1 + math.cos(math.pi * step / steps))
        for k, d in enumerate((t0, t1, r0, r1, flat.T @ y.reshape(-1, len(languages)), y.sum(axis=(0, 1)))):
            first[k] += 0.1 * (d - first[k])
            second[k] += 0.01 * (d * d - second[k])
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, (weights[0], weights[1]), (weights[2], weights[3]), weights[4], weights[5])


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def pooled(raws: list[bytes], m: Model) -> np.ndarray:
    """Mean probabilities over all bytes of each text."""
    owner = np.repeat(np.arange(len(raws)), [-(-len(r) // CORE) for r in raws])
    x = np.concatenate([overlapping(r) for r in raws]) if raws else overlapping(b"")
    out = np.zeros((len(raws), len(m.languages)))
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        y = position_probabilities(part, m)[MARGIN : MARGIN + CORE]
        y *= (part.T[MARGIN : MARGIN + CORE] < PAD)[:, :, None]
        np.add.at(out, owner[at : at + BLOCK], y.sum(axis=0))
    return out / np.maximum(1, [len(r) for r in raws])[:, None]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` plus `lang_pred` and `score`, the language of each whole text and its pooled probability.

    A null, empty or letterless text, or a missing model, gives UNKNOWN with score 0. Rows,
    repeated ones too, are independent; of equally likely languages the first in alphabetical
    order is said; existing columns of these names are replaced.
    """

    def make():
        def work(texts):
            known = [i for i, t in enumerate(texts) if model and has_letter(t)]
            p = pooled([texts[i].encode("utf-8", "replace") for i in known], model) if known else []
            said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, row in zip(known, p, strict=True):
                k = int(np.argmax(row))
                said[i], score[i] = model.languages[k], min(1.0, max(0.0, float(row[k])))
            return [said, score]

        return work

    return add_columns(docs, [text], "lang_pred string, score double", make)


def position_runs(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` plus `runs`, the label of every byte as runs (start, end, lang) over the UTF-8 text; none for null and empty texts."""

    def one(raw: bytes) -> list[dict]:
        x = overlapping(raw)
        parts = [position_probabilities(x[at : at + BLOCK], model)[MARGIN : MARGIN + CORE] for at in range(0, len(x), BLOCK)]
        labels = np.concatenate([p.argmax(axis=2).T.ravel() for p in parts])[: len(raw)]
        cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(raw)]
        return [{"start": a, "end": b, "lang": model.languages[labels[a]]} for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    make = lambda: lambda texts: [[one(t.encode("utf-8", "replace")) if t else [] for t in texts]]
    return add_columns(docs, [text], "runs array<struct<start:int,end:int,lang:string>>", make)


def held_out(id: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without id isn't, nor is it trained on."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Train on a sample of the documents that aren't held out and have id, text and language.

    The sample is bounded by its parameters: of each language the `per_language` documents with
    the lowest hash of their id, and of each of these `sample_chars` code points at most, from a
    place anywhere in the text that the hash names.
    """
    usable = docs.where(F.col(id).isNotNull() & F.col(lang).isNotNull() & ~held_out(id))
    counts = usable.groupBy(lang).count().collect()
    if not counts:
        return None
    order = F.pmod(F.xxhash64(F.col(id)), F.lit(1 << 40)) / float(1 << 40)
    # so few of each language pass that ranking them is a small job, yet enough of them to rank
    share = F.create_map(*[x for r in counts for x in (F.lit(r[lang]), F.lit(min(1.0, (1.5 * per_language + 60) / r["count"])))])
    few = usable.where(order < share[F.col(lang)]).where(F.col(text).rlike("[A-Za-z\\x{80}-\\x{10FFFF}]"))
    start = 1 + F.pmod(F.xxhash64(F.col(id), F.lit("place")), F.greatest(F.lit(1), F.length(text) - sample_chars + 1))
    part = F.substring(F.col(text), start.cast("int"), F.lit(sample_chars))
    ranked = few.select(F.col(lang).alias("lang"), part.alias("part"), order.alias("o")).withColumn("rank", F.expr("row_number() over (partition by lang order by o, part)"))
    rows = ranked.where(F.col("rank") <= per_language).select("lang", "part").collect()
    return train(sorted((r.lang, r.part) for r in rows))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`; see the README's contract table."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
