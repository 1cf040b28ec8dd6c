"""Benchmark decontamination with one Aho-Corasick automaton over all of a benchmark's windows.

Texts and items are reduced to words: A-Z lower-cased, every other ASCII sign a gap. Words are
numbered. Each run of `WINDOW` item words, or a whole shorter item, becomes one pattern, a sequence
of word numbers. A text's words are scanned once; what is found marks words, and runs of marked
words are mapped back to offsets in the original text.

What an automaton takes is measured before it is built. A benchmark that would take more than
BLOCK_BYTES is dealt into blocks that don't, each scanned in a pass of its own; all that is kept
of a pass is what it found.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.llm.common import add_columns, set_aside, table, without, written

WINDOW = 10
#: Bytes of memory that one automaton takes at most; a larger benchmark is scanned in several passes.
BLOCK_BYTES = 192 << 20
#: Measured: bytes that a word of a pattern takes, with its share of what the pattern itself does.
_NODE = 72
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original text, where A-Z are letters too
_RUNS = "array<struct<first:int,last:int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class Windows:
    """The automaton of some items: pattern to the items that have it."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.length = [i for i, _ in items], []
        self.shared: list[set[int]] = []  # a pattern of several items has the place here, from -1 down
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, (_, text) in enumerate(items):
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            self.length.append(min(size, len(words)))
            for i in range(max(1, len(words) - size + 1) if words else 0):
                pattern = words[i : i + size]
                before = self.automaton.get(pattern, None)
                if before is None:
                    self.automaton.add_word(pattern, k)
                elif before < 0:
                    self.shared[-1 - before].add(k)
                elif before != k:
                    self.shared.append({before, k})
                    self.automaton.add_word(pattern, -len(self.shared))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, int]], set[str], int]:
        """Runs of hit words as (first, last), the items found, and the number of words."""
        words = words_of(text)
        if not words or not len(self.automaton):
            return [], set(), len(words)
        runs, items = [], set()
        for end, k in self.automaton.iter(tuple(map(self.number.get, words, repeat(0)))):
            owners = (k,) if k >= 0 else self.shared[-1 - k]
            items.update(owners)
            runs.append((end + 1 - self.length[next(iter(owners))], end))
        return merged(runs), {self.ids[k] for k in items}, len(words)


def merged(runs) -> list[tuple[int, int]]:
    """Runs of word numbers (inclusive), joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(items: DataFrame, size: int, windows: int) -> DataFrame:
    """(id, t, weight) from items (id, t): those of more than so many windows in parts that have all windows between them; weight is what a part takes in an automaton."""

    def make():
        def one(text: str) -> list[dict]:
            words = words_of(text)
            starts = range(0, max(1, len(words) - size + 1), windows) if words else []
            parts = [words[a : a + windows + size - 1] for a in starts]
            weigh = lambda p: max(1, len(p) - size + 1) * min(size, len(p)) * _NODE + sum(map(len, p))
            return [{"t": b" ".join(p).decode("utf-8", "replace"), "weight": weigh(p)} for p in parts]

        return lambda texts: [[one(t) for t in texts]]

    cut = add_columns(items, ["t"], "parts array<struct<t:string,weight:long>>", make, rows=16)
    return cut.select("id", F.explode("parts").alias("p")).select("id", "p.t", "p.weight").distinct()


def blocks(parts: DataFrame, limit: int) -> list[DataFrame]:
    """`parts` in blocks of a weight of `limit` at most. Parts are dealt into cells by hash, cells into blocks in turn; only the weights of cells come to the driver."""
    total = parts.agg(F.sum("weight")).first()[0] or 0
    if total <= limit:
        return [parts]
    cells = -(-16 * total // limit)
    while True:
        cell = F.pmod(F.xxhash64("id", "t"), F.lit(cells))
        weights = {r.cell: r.w for r in parts.groupBy(cell.alias("cell")).agg(F.sum("weight").alias("w")).collect()}
        if max(weights.values()) <= limit:
            break
        cells *= 2
    bounds, held = [0], 0
    for c in sorted(weights):
        if held + weights[c] > limit:
            bounds.append(c)
            held = 0
        held += weights[c]
    return [parts.where((cell >= a) & (cell < b)) for a, b in zip(bounds, [*bounds[1:], cells], strict=True)]


#: The automaton that a Python worker holds, by a name of its own.
_built: dict[str, Windows] = {}


def _automaton(key: str, sent: Broadcast, size: int) -> Windows:
    if key not in _built:
        _built.clear()
        _built[key] = Windows(sent.value, size)
    return _built[key]


def _scanned(docs: DataFrame, block: DataFrame, size: int, text: str) -> DataFrame:
    """`docs` plus `hits`, `items` and `n_words` from one automaton."""
    sent = docs.sparkSession.sparkContext.broadcast([(r.id, r.t) for r in block.select("id", "t").collect()])
    key = uuid.uuid4().hex

    def make():
        automaton = _automaton(key, sent, size)

        def work(texts):
            out: tuple[list, list, list] = ([], [], [])
            for t in texts:
                runs, found, n = automaton.scan(t) if t else ([], set(), 0)
                out[0].append([{"first": a, "last": b} for a, b in runs])
                out[1].append(sorted(found))
                out[2].append(n)
            return out

        return work

    return add_columns(docs, [text], f"hits {_RUNS}, items array<string>, n_words long", make)


def _put_together(docs: DataFrame, found: DataFrame, text: str, key: Column) -> DataFrame:
    """`docs` plus `hits`, `items` and `n_words` from what the passes found in texts, by the texts' hashes."""

    def make():
        def work(texts, runs, items):
            joined = [merged((x["first"], x["last"]) for x in r or []) for r in runs]
            return [[[{"first": a, "last": b} for a, b in r] for r in joined], [sorted(set(i or [])) for i in items], [len(words_of(t)) if t else 0 for t in texts]]

        return work

    once = found.groupBy("key", "block").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
    once = once.groupBy(F.col("key").alias("__key")).agg(F.flatten(F.collect_list("hits")).alias("__hits"), F.flatten(F.collect_list("items")).alias("__items"))
    met = docs.withColumn("__of", key).join(written(once), F.col("__of") == F.col("__key"), "left").drop("__of", "__key")
    out = add_columns(met, [text, "__hits", "__items"], f"hits {_RUNS}, items array<string>, n_words long", make)
    return out.drop("__hits", "__items")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` plus `hits` (runs of hit words, first and last word number), `items` (ids as sorted strings) and `n_words`.

    The benchmark is weighed before it is sent to the executors: up to `block_bytes` it is one
    automaton and one scan. Beyond that it is dealt into blocks of this weight at most, very long
    items in parts; each block is scanned in a pass of its own that keeps what it found in the
    texts that hold something, and a last pass joins these by the texts' hashes. Null and
    wordless texts and items hit nothing; repeated rows and repeated items count as themselves,
    windows that several items share count for each; an item without id is found under the id
    "null". Existing columns named hits, items or n_words are replaced.
    """
    docs = without(docs, ["hits", "items", "n_words"])
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("t")).where("t is not null")
    parts = pieces(items, size, max(1, block_bytes // (16 * size * _NODE)))
    parts = written(parts)
    dealt = blocks(parts, block_bytes)
    if len(dealt) == 1:
        return _scanned(docs, dealt[0], size, text)
    key, found = F.struct(F.xxhash64(F.col(text), F.length(text)), F.crc32(F.col(text).cast("binary"))), None
    texts = docs.select(F.col(text).alias("text"), key.alias("key")).where("text is not null")
    for number, block in enumerate(dealt):
        hit = written(_scanned(texts, block, size, "text").where(F.size("hits") > 0).select("key", F.lit(number).alias("block"), "hits", "items"))
        found = hit if found is None else found.unionByName(hit)
    return _put_together(docs, found, text, key)


def hit_spans(docs: DataFrame, text: str = "text", hits: str = "hits", spans: str = "spans") -> DataFrame:
    """`docs` plus `spans`, the hit runs as (start, end) code points of the original text."""

    def make():
        def work(texts, runs):
            out = []
            for t, r in zip(texts, runs, strict=True):
                where = [m.span() for m in _WORD.finditer(t)] if r else []
                out.append([{"start": where[x["first"]][0], "end": where[x["last"]][1]} for x in r or []])
            return [out]

        return work

    return add_columns(docs, [text, hits], f"`{spans}` array<struct<start:int,end:int>>", make)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, in which no benchmark window occurs."""
    free, restored = set_aside(docs, ["hits", "items", "n_words"])
    return restored(contaminated_words(free, benchmark, text=text).where(F.size("hits") == 0))


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark words in every whole text of `documents`; see the README's contract table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hit_spans(contaminated_words(docs, table(spark, sf_dir, "benchmark")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "spans",
    )


OP8_SQL = r"""
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, text
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
found AS (
  SELECT g.r, g.i, g.n, win.id FROM (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) g
  JOIN win ON win.n = g.n AND win.s = g.s),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM found) GROUP BY r),
word AS (
  SELECT r, p, m, sum(len(m) + len(gap)) OVER (PARTITION BY r ORDER BY p) - len(m) AS a, sum(len(m) + len(gap)) OVER (PARTITION BY r ORDER BY p) AS b
  FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS m,
          unnest(regexp_split_to_array(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')[1:len(w)]) AS gap
        FROM dw WHERE r IN (SELECT r FROM hit))),
run AS (
  SELECT r, min(a) AS a, max(b) AS b FROM (
    SELECT word.r, word.p - row_number() OVER (PARTITION BY word.r ORDER BY word.p) AS isle, a, b
    FROM word JOIN (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) h ON h.r = word.r AND h.p = word.p)
  GROUP BY r, isle),
span AS (SELECT r, list({'start': CAST(a AS INTEGER), 'end': CAST(b AS INTEGER)} ORDER BY a) AS spans FROM run GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, []) AS spans
FROM dw LEFT JOIN hit USING (r) LEFT JOIN item USING (r) LEFT JOIN span USING (r)
"""
