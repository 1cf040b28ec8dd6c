"""Quality rules: a decision list learned by sequential covering and run as Spark conditionals.

Statistics of each text are the features. Rules that reject are grown one at a time: starting
from no condition, the threshold condition with the best information gain is added until the
rule covers no accepted row; the rule is then pruned from the end while that makes it no worse
on rows kept aside, and is taken only if it is precise enough on both. What it covers is taken
away before the next is grown. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.llm.common import add_columns, table

#: Labelled documents that a list is learned from at most (those with the lowest hash of their id).
MAX_LABELLED = 4000
MIN_WORDS, MAX_REPEATED = 50, 50
_SYMBOLS, _UPPER, _DIGIT, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digit", "n_marks")
#: What apply_rules adds.
COLUMNS = (*_COUNTS, "base_failed", "rule", "kept")
FEATURES = ("n_words", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "digit_ratio", "mark_ratio")


def counts(text: str) -> tuple[int, ...]:
    """The values of _COUNTS for one text; words end at ASCII white space."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    grams = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = 0
    if len(set(grams)) < len(grams):
        seen: set = set()
        twice = {g for g in grams if g in seen or seen.add(g)}
        reach = 0  # the word after the last one counted
        for i, g in enumerate(grams):
            if g in twice:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines, lines_seen, same = raw.split(b"\n"), set(), 0
    filled = 0
    for line in lines:
        if line.split(None, 1):
            filled += 1
            same += line in lines_seen
            lines_seen.add(line)
    kept = lambda which: len(raw) - len(raw.translate(None, which))
    chars = len(raw.translate(None, b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))))  # each code point has one byte that continues none
    return len(words), chars, kept(_SYMBOLS), same, repeated, filled, kept(_UPPER), kept(_DIGIT), kept(_MARKS)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus the columns of _COUNTS; null and empty texts have zeros, existing columns of these names are replaced."""

    def make():
        zero = (0,) * len(_COUNTS)
        return lambda texts: [list(c) for c in zip(*[counts(t) if t else zero for t in texts], strict=True)] or [[] for _ in _COUNTS]

    return add_columns(docs, [text], ", ".join(f"{c} long" for c in _COUNTS), make)


def feature_columns() -> dict[str, Column]:
    """Each feature as a Column over the counts; a share of nothing is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"), "symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words"), "upper_ratio": share("n_upper", "word_chars"),
        "digit_ratio": share("n_digit", "word_chars"), "mark_ratio": share("n_marks", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray, now: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the best information gain over the rows `now` that a rule covers."""
    p0, n0 = bad[now].sum(), (~bad[now]).sum()
    before, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[now, k], kind="stable")
        v, y = x[now, k][order], bad[now][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1e-9) / (pp + nn)) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, aside: np.ndarray, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Rules that reject, in order. x: features; bad: rows to reject; aside: rows kept for pruning.

    A rule is taken if at least `least` of the rows it covers are bad and their share is
    `precision` or more, both over all rows and over those kept aside (where it covers any). What
    a rule that isn't taken covers is set aside, and growing goes on with the other bad rows
    until none is left.
    """
    rules: list[Rule] = []
    left, tried = np.ones(len(x), bool), np.zeros(len(x), bool)
    while (left & ~aside & ~tried & bad).any():
        now, rule = left & ~aside & ~(tried & bad), ()
        while (now & ~bad).any():
            gain, condition = _best(x, bad, now)
            if condition is None:
                break
            rule, now = (*rule, condition), now & condition.holds(x)

        def worth(r: Rule) -> float:
            c = covers(r, x) & left & aside
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, x) & left
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        kept_p, kept_n = (hit & aside & bad).sum(), (hit & aside & ~bad).sum()
        if not rule or p < least or p < precision * (p + n) or kept_p < precision * (kept_p + kept_n):
            if not rule:
                break
            tried |= hit
            continue
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered CASE: the number of the first rule that rejects, or null."""
    features, out = feature_columns(), None
    for number, rule in enumerate(rules):
        test = F.lit(True)
        for condition in rule:
            test &= condition.column(features)
        out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text: str = "text") -> list[Rule]:
    """Learn the list from documents that have a quality label.

    Of the labelled ids, the `max_labelled` with the lowest hash are used, whatever the input's
    size; that sample is what is broadcast and what comes to the driver. Null ids and labels
    are left out; of several labels of one id the lowest counts, of several texts of one id that with
    the lowest statistics. Nothing to learn from, or labels of one kind only, gives an empty list,
    which keeps all.
    """
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    found = with_counts(docs.select("doc_id", F.col(text).alias("__text")).join(F.broadcast(sample), "doc_id"), "__text").where(~base_failed())
    # one row for each id, whatever number of rows repeat it
    features = F.struct(*[c.alias(f"f_{k}") for k, c in feature_columns().items()])
    least = found.groupBy("doc_id").agg(F.min("__quality").alias("__quality"), F.min(features).alias("f"))
    rows = least.select("doc_id", "__quality", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(3)).alias("part"), "f.*").collect()
    if not rows:
        return []
    rows.sort(key=lambda r: tuple(r))
    x = np.array([[r[f"f_{k}"] for k in FEATURES] for r in rows])
    return learn(x, np.array([r["__quality"] < 1 for r in rows]), np.array([r.part == 0 for r in rows]))


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """`docs` plus the counts, `base_failed`, `rule` (number of the rule that rejects, or null) and `kept`.

    Null and empty texts fail the base; ties go to the first rule; existing columns of these
    names are replaced.
    """
    marked = with_counts(docs.drop("base_failed", "rule", "kept"), text)
    return marked.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on every whole text of `documents`; see the README's contract table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
