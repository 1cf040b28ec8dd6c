"""Chat formatting of reply trees.

Messages with parents form trees. Iterative self-joins first climb: in each round every message
is joined with the ancestor it has reached, so that the reach doubles and the rounds are the
logarithm of the deepest tree; the score of every path from root to leaf is summed on the way.
Branches are ranked within their tree. Then the same tables, joined from the farthest reach to
the nearest, enumerate the chosen paths, and each is formatted as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenara.llm.common import checkpointed, table

#: The strings that mark a turn, `OPEN role BODY text CLOSE`.
OPEN, BODY, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What stands for a sign that could begin or imitate a mark; every backslash in a formatted text begins one of these.
ESCAPES = (("\\", r"\e"), ("<", r"\l"), ("[", r"\b"))
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def climbed(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps and totals: for each k a table (tree, message, up) of the ancestors 2^k above, and (tree, message, total, n) of each path from the root.

    A round joins only the messages that haven't passed the root yet with what is known of the
    ancestors they have reached, so there are as many rounds as the logarithm of the deepest
    tree, and a shallow tree takes part in few of them. Messages on or below a cycle never pass
    a root and get no total.
    """
    found = messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
    known = found.select("tree", F.col("message").alias("parent"), F.lit(True).alias("there"))
    linked = found.join(known, ["tree", "parent"], "left")
    now = checkpointed(linked.select("tree", "message", F.when(F.col("there"), F.col("parent")).alias("up"), "total", F.lit(1).cast("long").alias("n")))
    deepest = now.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    done, jumps = now.where("up IS NULL"), []
    now = now.where("up IS NOT NULL")
    for _ in range(deepest.bit_length()):
        if now.isEmpty():
            break
        jumps.append(now.select("tree", "message", "up"))
        above = done.unionByName(now).select("tree", F.col("message").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("n").alias("steps"))
        made = checkpointed(now.join(above, ["tree", "up"]).select("tree", "message", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("steps")).alias("n")))
        done, now = done.unionByName(made.where("up IS NULL")), made.where("up IS NOT NULL")
    return jumps, done.drop("up")


def branches(jumps: list[DataFrame], totals: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, branch, score): the `best` leaves of each tree by their path's mean score, of equal ones the lower leaf; all if None."""
    leaves = totals.select("tree", F.col("message").alias("leaf"), (F.col("total") / F.col("n")).alias("score"))
    if jumps:
        inner = jumps[0].select("tree", F.col("up").alias("leaf")).distinct()
        leaves = leaves.join(inner, ["tree", "leaf"], "left_anti")
    if best == 1:
        first = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("score")).alias("low"), "leaf")).alias("first"))
        return first.select("tree", F.col("first.leaf").alias("leaf"), F.lit(1).alias("branch"), (-F.col("first.low")).alias("score"))
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if best is None else ranked.where(F.col("branch") <= best)


def steps(jumps: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """(tree, branch, score, message, height) for every message from each chosen leaf (height 0) to its root.

    Heights are filled in from the farthest jump to the nearest; the rows are those of the
    result, each made once.
    """
    out = checkpointed(chosen.select("tree", "branch", "score", F.col("leaf").alias("message"), F.lit(0).cast("long").alias("height")))
    for k in range(len(jumps) - 1, -1, -1):
        reached = out.join(jumps[k], ["tree", "message"]).select("tree", "branch", "score", F.col("up").alias("message"), (F.col("height") + (1 << k)).alias("height"))
        out = checkpointed(out.unionByName(reached))
    return out


def formatted(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, branch, score, formatted, loss_spans): the `best` paths of each tree (all if None) as conversations.

    `messages` has tree, message (unique in its tree), parent, role, text and score. A message
    whose parent is null or isn't in the tree is a root; a path that never reaches a root, as
    it runs into a cycle, is none. A branch scores the mean of its messages' scores (null
    counts as 0); ties go to the lower leaf; `branch` counts from 1. Null texts and roles are
    empty. `loss_spans` are the (start, end) code points of the formatted text that training
    learns from, the escaped texts of the assistant's turns. An empty table gives none; further
    columns are ignored.
    """
    jumps, totals = climbed(messages)
    clean = messages.select("tree", "message", F.coalesce("role", F.lit("")).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    turns = steps(jumps, branches(jumps, totals, best)).join(clean, ["tree", "message"])
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BODY)))
    turn = F.struct((-F.col("height")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("said"), F.length("head").alias("head"), F.length("body").alias("body"), (F.col("role") == LEARNED_ROLE).alias("learned"))
    # where each turn starts: a running sum over the turns of one conversation
    before = Window.partitionBy("tree", "branch").orderBy("t.at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select("tree", "branch", "score", turn.alias("t")).withColumn("from", F.coalesce(F.sum(F.length("t.said")).over(before), F.lit(0)))
    span = F.struct((F.col("from") + F.col("t.head")).cast("int").alias("start"), (F.col("from") + F.col("t.head") + F.col("t.body")).cast("int").alias("end"))
    gathered = placed.groupBy("tree", "branch", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("t.at").alias("at"), F.col("t.said").alias("said")))), lambda x: x["said"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("t.learned"), span))).alias("loss_spans"),
    )
    return gathered.select("tree", "branch", "score", "formatted", "loss_spans")


def parsed(text: str = "formatted") -> Column:
    """The (role, text) turns that a formatted conversation says."""
    pieces = F.filter(F.split(F.col(text), CLOSE), lambda p: p != "")
    part = lambda p, n: unescaped(F.get(F.split(F.substring(p, len(OPEN) + 1, 1 << 30), r"\[/INST\]"), F.lit(n)))
    return F.transform(pieces, lambda p: F.struct(part(p, 0).alias("role"), part(p, 1).alias("text")))


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations of (conv_id, turn, role, text) as trees of a single branch.

    Rows follow each other by turn, then role and text; a null turn comes first; repeated rows
    are turns of their own; rows without conversation id are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("message"))
    tree = F.when(F.col("conv_id").isNull(), F.lit("null")).otherwise(F.col("conv_id").cast("string"))
    parent = F.when(F.col("message") > 1, F.col("message") - 1)
    return numbered.select(tree.alias("tree"), "message", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(out: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = unescaped(F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])), ""))
    read = out.withColumn("turns", parsed()).withColumn("learned", learned)
    return read.select(
        "tree", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All `conversations` and one whose texts imitate the template; see the README's contract table."""
    said = f"{CLOSE}[INST] ok {BODY}"
    extra = spark.range(1, 3).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 1, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = digest(formatted(linear(rows)))
    return out.withColumn("conv_id", F.expr("try_cast(tree AS bigint)")).drop("tree")


_LENGTH = "length(replace(replace(replace({0}, '\\', '\\e'), '<', '\\l'), '[', '\\b'))"
OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum({_LENGTH.format('r')} + {_LENGTH.format('t')} + {len(OPEN + BODY + CLOSE)})::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
