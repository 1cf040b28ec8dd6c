"""Line dedup with a fixed-depth template tree.

A line's tokens that hold a digit become `<*>`. Its leaf in the tree is its number of tokens and
its first LEAD tokens, or all of them where there are fewer. The tokens after those are cut into
SEGMENTS parts at most, of nearly equal length. A template is a leaf with some of its parts made
variable: as many as leave ALIKE of the tokens fixed, two at most. A line so has a handful of
templates, and two lines share one if they differ in those parts only. A template recurs if
MIN_DOCS different texts hold lines of it. A line of LONG tokens or more recurs from two texts on
if it stands there as it is, but for tokens with digits.

A line is dropped if an earlier one (by document id, then line number) shares a recurring template
with it. So the first line of whatever repeats stays in the corpus. Whole copies of a text count once.

Everything is found by one pass over the lines and a fixed number of aggregations, whatever the
leaves hold; no leaf or template is ever gathered in one task.
"""

from __future__ import annotations

import re
import struct
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenara.llm.common import add_columns, give_back, table, without, written

MIN_DOCS, LEAD, ALIKE = 3, 3, 0.75
SEGMENTS, VARIABLE = 8, 2
#: Tokens from which a line that stands in two texts recurs.
LONG = 50
#: Leaves up to which their table (8 bytes each) is sent to all executors; more are met by a join.
SENT_LEAVES = 1 << 20
#: Bytes of text after which rows that were made of it are handed on.
_HAND_ON = 1 << 20
#: Texts that are cut at once.
_ROWS = 128
_DIGIT = re.compile(rb"[0-9]")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text), F.length(text))


def _signed(data: bytes) -> int:
    number = xxhash.xxh3_64_intdigest(data)
    return number - (1 << 64) if number >> 63 else number


def parsed(text: str) -> dict[bytes, tuple[list[bytes], list[int]]]:
    """The masked lines of a text that have a token: the tokens of each and the numbers of the lines that it stands in."""
    out: dict[bytes, tuple[list[bytes], list[int]]] = {}
    for no, line in enumerate(text.encode("utf-8", "replace").split(b"\n")):
        tokens = line.split()
        if tokens:
            if _DIGIT.search(line):
                tokens = [b"<*>" if _DIGIT.search(t) else t for t in tokens]
            out.setdefault(b" ".join(tokens), (tokens, []))[1].append(no)
    return out


def segments(tokens: list[bytes]) -> list[bytes]:
    """The tokens after the leading ones in SEGMENTS parts, or in one part each if they are fewer."""
    rest = tokens[LEAD:]
    n = min(SEGMENTS, len(rest))
    return [b" ".join(rest[len(rest) * i // n : len(rest) * (i + 1) // n]) for i in range(n)]


def variable(n_tokens: int) -> int:
    """How many parts of a line of so many tokens are variable in a template."""
    parts = min(SEGMENTS, max(0, n_tokens - LEAD))
    return min(parts, VARIABLE, int((1 - ALIKE) * n_tokens))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, th, n, leaf, lh, parts, nos): a row for each different masked line of each text; th tells texts of one id apart.

    n is the number of tokens, leaf, lh and parts are hashes of the leaf, the line and its
    parts, nos the numbers of the lines in the text. No row carries a text.
    """
    docs = docs.where(F.col(text).isNotNull()).select("id", _text_hash(text).alias("th"), F.col(text).alias("text"))
    schema = T.StructType([*docs.schema.fields[:2], *T.DataType.fromDDL("n int, leaf long, lh long, parts array<long>, nos array<int>").fields])

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        where, *columns = zip(*rows, strict=True)
        keys = batch.select([0, 1]).take(pa.array(where, pa.int64()))
        typed = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)]
        return pa.RecordBatch.from_arrays([*keys.columns, *typed], names=schema.fieldNames())

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for masked, (tokens, nos) in parsed(text).items():
                    leaf = b"%d %s" % (len(tokens), b" ".join(tokens[:LEAD]))
                    rows.append((i, len(tokens), _signed(leaf), _signed(masked), [_signed(s) for s in segments(tokens)], nos))
                size += len(text)
                if rows and size >= _HAND_ON:
                    yield made(batch, rows)
                    rows, size = [], 0
            if rows:
                yield made(batch, rows)
            batch = rows = text = tokens = None
            give_back()

    return docs.mapInArrow(run, schema)


def template_keys(n: int, leaf: int, lh: int, parts: list[int]) -> list[tuple[int, int]]:
    """(key, number of texts from which it recurs) of a masked line's templates."""
    out = []
    for open_ in combinations(range(len(parts)), variable(n)):
        fixed = [0 if i in open_ else x for i, x in enumerate(parts)]
        out.append((_signed(struct.pack(f"<{len(parts) + 2}q", leaf, sum(1 << i for i in open_), *fixed)), MIN_DOCS))
    if n >= LONG:
        out.append((_signed(struct.pack("<q", lh)), 2))
    return out


def group_keys(n: int, leaf: int, parts: list[int]) -> list[int]:
    """Keys of the parts cut into one group more than may be variable: lines that share a template share a group."""
    groups, size = variable(n) + 1, len(parts)
    cut = [parts[size * g // groups : size * (g + 1) // groups] for g in range(groups)]
    return [_signed(struct.pack(f"<{len(c) + 2}q", leaf, g, *c)) for g, c in enumerate(cut)]


def _with_company(forms: DataFrame) -> DataFrame:
    """The masked lines that share a group of parts with enough texts' lines; the others have no recurring template."""

    def make():
        return lambda *columns: [[group_keys(*x) for x in zip(*columns, strict=True)]]

    grouped = add_columns(forms.select("leaf", "lh", "n", "texts", "parts"), ["n", "leaf", "parts"], "groups array<long>", make)
    grouped = grouped.select("leaf", "lh", "n", "texts", F.explode("groups").alias("group"))
    enough = F.when(F.col("n") >= LONG, F.lit(2)).otherwise(F.lit(MIN_DOCS))
    met = written(grouped.groupBy("group", "n").agg(F.sum("texts").alias("s")).where(F.col("s") >= enough).select("group"))
    return forms.join(written(grouped.join(met, "group", "left_semi").select("leaf", "lh").distinct()), ["leaf", "lh"], "left_semi")


def _first_of_each(found: DataFrame) -> DataFrame:
    """(leaf, lh, first): for each masked line with a recurring template, the earliest place of a line that shares one."""
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("i"), F.col("th").alias("t"), F.array_min("nos").alias("n"))
    texts = found.groupBy("leaf", "lh", "th").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("parts").alias("parts"))
    forms = texts.groupBy("leaf", "lh").agg(F.count("*").alias("texts"), F.min("th").alias("low"), F.max("th").alias("high"), F.min("first").alias("first"), F.first("n").alias("n"), F.first("parts").alias("parts"))
    forms = _with_company(written(forms))

    def make():
        return lambda *columns: [[[{"key": k, "need": m} for k, m in template_keys(*x)] for x in zip(*columns, strict=True)]]

    keyed = add_columns(forms, ["n", "leaf", "lh", "parts"], "keys array<struct<key:long,need:int>>", make)
    keyed = written(keyed.select("leaf", "lh", "texts", "low", "high", "first", F.explode("keys").alias("k")).select("leaf", "lh", "texts", "low", "high", "first", "k.key", "k.need"))
    # the texts of a line that stands in fewer than three are the lowest and the highest
    sure = (F.col("texts") >= MIN_DOCS).alias("sure")
    each = keyed.select("key", "need", sure, "first", F.explode(F.array("low", "high")).alias("th"))
    each = each.groupBy("key", "need", "th").agg(F.max("sure").alias("sure"), F.min("first").alias("first"))
    counted = each.groupBy("key", "need").agg(F.max("sure").alias("sure"), F.count("*").alias("texts"), F.min("first").alias("first"))
    recurring = written(counted.where(F.col("sure") | (F.col("texts") >= F.col("need"))).select("key", "need", "first"))
    met = keyed.select("leaf", "lh", "key", "need").join(recurring, ["key", "need"])
    return met.groupBy("leaf", "lh").agg(F.min("first").alias("first"))


def dropped_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, th, dropped): the numbers of each text's lines that go."""
    all_lines = written(lines(docs, text))
    # a leaf that too few texts reach has no recurring template
    reached = all_lines.select("leaf", "n", "th").distinct().groupBy("leaf", "n").agg(F.count("*").alias("texts"))
    leaves = written(reached.where(F.col("texts") >= F.when(F.col("n") >= LONG, F.lit(2)).otherwise(F.lit(MIN_DOCS))).select("leaf"))
    sent = F.broadcast(leaves) if leaves.count() <= SENT_LEAVES else leaves
    found = written(all_lines.join(sent, "leaf", "left_semi"))
    first = written(_first_of_each(found))
    met = found.select("id", "th", "leaf", "lh", "nos").join(first, ["leaf", "lh"])
    later = F.filter("nos", lambda no: F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("i"), F.col("th").alias("t"), no.alias("n")) > F.col("first"))
    gone = met.select("id", "th", later.alias("nos")).where(F.size("nos") > 0)
    return gone.groupBy("id", "th").agg(F.array_sort(F.flatten(F.collect_set("nos"))).alias("dropped"))


def without_recurring_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", marks: bool = False, most: float | None = None) -> DataFrame:
    """`docs` with the lines of recurring templates cut from the text, other columns unchanged.

    With `marks`, also n_lines, n_dropped (long) and dropped (line numbers from 0); existing
    columns of these names are replaced then. With `most`, a text that would lose more than this
    share of its words stays whole: it is a copy of earlier texts, which near dedup decides on.
    A null text stays null with no lines, an empty one has one line; blank lines always stay. Of
    two equal lines in one text the later one goes if their template recurs. Repeated rows (same
    id, same text) are one text and keep the same lines; null ids come last in the order that
    decides which line is first. A text of any length is parsed line by line, and what leaves
    the parse are hashes and line numbers.
    """
    docs = without(docs, ["n_lines", "n_dropped", "dropped"]) if marks else docs
    gone = dropped_lines(docs.select(F.col(id).alias("id"), F.col(text).alias(text)), text)
    gone = written(gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("dropped").alias("__dropped")))
    # dealt out by text at every size, as what is cut grows with the corpus
    met = docs.hint("merge").join(gone, F.col(id).eqNullSafe(F.col("__id")) & (_text_hash(text) == F.col("__th")), "left").drop("__id", "__th")
    return _cut(met, text, marks, most)


def _cut(met: DataFrame, text: str, marks: bool, most: float | None) -> DataFrame:
    """`met` without its column __dropped, the lines of these numbers cut from the text, which is replaced where it stands and not carried twice."""
    at, last = met.columns.index(text), len(met.columns) - 1
    met = met.select(*[c for c in met.columns if c != "__dropped"], "__dropped")
    added = T.DataType.fromDDL("n_lines long, n_dropped long, dropped array<int>").fields if marks else []
    schema = T.StructType([*met.schema.fields[:last], *added])

    def one(whole: str | None, numbers: list[int] | None) -> tuple:
        if whole is None:
            return None, 0, 0, []
        if not numbers:
            return whole, whole.count("\n") + 1, 0, []
        parts, off = whole.split("\n"), set(numbers)
        if most is not None and sum(len(parts[k].split()) for k in off) > most * len(whole.split()):
            return whole, len(parts), 0, []
        return "\n".join(p for k, p in enumerate(parts) if k not in off), len(parts), len(off), sorted(off)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                done = [one(t, n) for t, n in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
                columns = batch.columns[:last]
                columns[at] = pa.array([d[0] for d in done], pa.string())
                if marks:
                    columns += [pa.array([d[k] for d in done], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            whole = batch = done = columns = None
            give_back()

    return met.mapInArrow(run, schema)


def op7_line_templates(spark, sf_dir: str) -> DataFrame:
    """Line dedup over whole `documents`: doc_id, n_lines, n_dropped, dropped, text_sha256; see the README's contract table."""
    out = without_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), marks=True)
    return out.select("doc_id", "n_lines", "n_dropped", "dropped", F.sha2(F.col("text"), 256).alias("text_sha256"))
