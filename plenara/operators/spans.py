"""Span operators over documents: longest common spans, quotes, sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _longest_run(left: list[str], right: list[str]) -> int:
    """The length of the longest run of tokens that both lists have: the right one is read through the suffix automaton of the left."""
    step, link, length, last = [{}], [-1], [0], 0
    for token in left:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and token not in step[at]:
            step[at][token] = now
            at = link[at]
        if at >= 0:
            to = step[at][token]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(token) == to:
                    step[at][token] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    best = run = at = 0
    for token in right:
        while at and token not in step[at]:
            at = link[at]
            run = length[at]
        if token in step[at]:
            at, run = step[at][token], run + 1
            best = max(best, run)
    return best


@F.pandas_udf(T.LongType())
def longest_run(left: pd.Series, right: pd.Series) -> pd.Series:
    """Rows of token arrays to the length of their longest common run, in time that follows the tokens of both."""
    return pd.Series([_longest_run(list(a), list(b)) if len(a) <= len(b) else _longest_run(list(b), list(a)) for a, b in zip(left, right, strict=True)], dtype="int64")


def longest_common_spans(pairs: DataFrame, left: str = "left", right: str = "right", *keys: str) -> DataFrame:
    """(keys, span, n_left, n_right) for each pair of token arrays: the tokens of their longest common run. A row stays a row: nothing is shuffled."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(left, none), F.coalesce(right, none)
    return pairs.select(*keys, longest_run(a, b).alias("span"), F.size(a).alias("n_left"), F.size(b).alias("n_right"))


#: Runs of quotes up to which their table (some 30 bytes each) is sent to all executors; more are met by a join.
SENT_RUNS = 1 << 20


def runs(tokens: Column, size: Column | int) -> Column:
    """Hashes of all runs of `size` tokens; none of fewer tokens."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.size(tokens) - size + 1)
    none = F.array().cast("array<bigint>")
    return F.when((F.size(tokens) >= size) & (size > 0), F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, size)))).otherwise(none)


def met_by_runs(quotes: DataFrame, documents: DataFrame, quote: str, document: str, size: int) -> DataFrame:
    """(quote, document): ids of quotes and documents (id, tokens) that share a run of `size` tokens, or a shorter quote's whole.

    The quotes' runs are counted. If they are few they go to all executors, and only the
    documents' runs that meet one ever leave their task; otherwise both sides are joined by run.
    """
    of = F.least(F.lit(size), F.size("tokens"))
    mine = quotes.where(F.size("tokens") > 0).select(F.col(quote), of.alias("size"), F.explode(runs(F.col("tokens"), of)).alias("run")).distinct()
    sizes = sorted(r["size"] for r in mine.select("size").distinct().collect())  # `size` values at most
    sent = F.broadcast(mine) if mine.count() <= SENT_RUNS else mine
    out = None
    for n in sizes:
        part = documents.select(F.col(document), F.lit(n).alias("size"), F.explode(runs(F.col("tokens"), n)).alias("run"))
        part = part.join(sent, ["size", "run"]).select(quote, document)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return quotes.where(F.lit(False)).select(quote).join(documents.where(F.lit(False)).select(document))
    return out.distinct()


def span_ratios(spans: DataFrame) -> DataFrame:
    """overlap (of both), coverage (of the right, the expected quote) and precision (of the left, the submitted one)."""
    n = F.col("n_left") + F.col("n_right")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return spans.withColumns({"overlap": share(2 * F.col("span"), n), "coverage": share(F.col("span"), F.col("n_right")), "precision": share(F.col("span"), F.col("n_left"))})


def longest_sentences(docs: DataFrame, sentences, key: str, *within: str, top: int = 3) -> DataFrame:
    """The `top` longest sentences of each group `within` (of each key without), by length, then key, then the sentence."""
    every = docs.select(*dict.fromkeys([*within, key]), F.explode(sentences).alias("sentence"))
    order = Window.partitionBy(*(within or (key,))).orderBy(F.desc(F.length("sentence")), key, "sentence")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
