"""Projections of snapshots and scenarios: public views, prompts, task rows, document views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenara.functions import text as X
from plenara.functions.votes import vote_symbol
from plenara.operators import matrix

PROMPT_MODES = ("full", "matrix-only", "text-only", "shuffled-text")
#: The words of the vote prompt.
OPENING = ("Predict the held-out votes in this deliberation snapshot.", "Votes use 1=agree, -1=disagree, 0=pass/unsure, ?=not seen or masked.", "", "Statements:")
WITHHELD_TEXT = "[policy text withheld for matrix-only ablation]"
WITHHELD_MATRIX = "Visible vote matrix withheld for this text-only ablation."
INSTRUCTIONS = "\n".join((
    "Return a probability distribution for every masked cell.",
    "Each distribution must contain exactly agree, disagree, and pass, use finite non-negative numbers, and have a positive total.",
    "Return STRICT JSON only, with this shape:",
    '{"predictions":{"<participant_idx>,<statement_idx>":{"agree":0.0,"disagree":0.0,"pass":0.0}}}',
    "Your entire response must begin with { and end with }.",
    "Do not use Markdown code fences or explanatory prose.",
))
ROTATION_SALT = "shuffled-text-v1"


def nested(visible: DataFrame, hidden: DataFrame, statements: int) -> DataFrame:
    """Snapshots of long cells: participants numbered in their order, every statement a column, hidden cells in rank order."""
    people = visible.select("session", "p").distinct().groupBy("session").agg(F.array_sort(F.collect_list("p")).alias("people"))
    rows = visible.groupBy("session", "p").agg(F.map_from_entries(F.collect_list(F.struct("s", "vote"))).alias("by"))
    row = F.transform(F.sequence(F.lit(0), F.lit(statements - 1)), lambda s: F.col("by")[s])
    votes = rows.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", row.alias("row")))), lambda x: x["row"]).alias("votes"))
    place = (F.array_position("people", F.col("p")) - 1).cast("int")
    cells = hidden.join(people, "session").select("session", "rank", place.alias("i"), "s", "vote").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "i", "s", "vote"))).alias("h"))
    out = people.join(votes, "session").join(cells, "session", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    hid = none(F.col("h"), "array<struct<rank:int,i:int,s:int,vote:int>>")
    return out.select(
        F.col("session").alias("session_id"), F.transform(F.sequence(F.lit(0), F.lit(statements - 1)), lambda s: F.struct(s.alias("index"), F.concat(F.lit("statement "), s.cast("string")).alias("text"))).alias("statements"),
        F.transform("people", lambda p: F.concat(F.lit("u"), p.cast("string"))).alias("participants"), "votes", F.transform(hid, lambda x: F.array(x["i"], x["s"])).alias("masked_cells"),
        F.map_from_entries(F.transform(hid, lambda x: F.struct(F.concat_ws(",", x["i"].cast("string"), x["s"].cast("string")), x["vote"]))).alias("held_out"),
        F.transform("people", lambda p: (p % 3).cast("int")).alias("clusters"), F.struct(F.lit(5).alias("k_anonymity"), F.lit("events").alias("source"), F.lit(True).alias("synthetic")).alias("meta"),
    )


def rotation(session: Column, count: Column, salt: str = ROTATION_SALT) -> Column:
    """How far the texts of a session are turned: 1 + the first 8 bytes of SHA-256(salt:session) modulo (count - 1). The salt is the data producer's."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), session), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (1 + F.pmod(head, (count - 1).cast("decimal(20,0)"))).cast("int")


def statement_texts(mode: str, salt: str = ROTATION_SALT) -> Column:
    """The statements' texts as a prompt mode shows them."""
    if mode not in PROMPT_MODES:
        raise ValueError(f"unknown prompt mode {mode!r}; valid modes: {', '.join(PROMPT_MODES)}")
    texts = F.transform("statements", lambda s: s["text"])
    if mode == "matrix-only":
        return F.transform(texts, lambda t: F.lit(WITHHELD_TEXT))
    if mode == "shuffled-text":
        n = F.size(texts)
        k = F.when(n > 1, rotation(F.col("session_id").cast("string"), n, salt)).otherwise(F.lit(0))
        return F.concat(F.slice(texts, k + 1, n - k), F.slice(texts, F.lit(1), k))
    return texts


def vote_prompt(mode: str = "full", salt: str = ROTATION_SALT) -> Column:
    """The prompt of a nested snapshot."""
    index = F.transform("statements", lambda s: s["index"].cast("string"))
    lines = F.zip_with(index, statement_texts(mode, salt), lambda i, t: F.concat(i, F.lit(": "), t))
    if mode == "text-only":
        shown = F.array(F.lit(""), F.lit(WITHHELD_MATRIX))
    else:
        name = lambda p: F.concat(F.lit("p"), F.when(p < 10, F.lit("0")).otherwise(F.lit("")), p.cast("string"), F.lit(": "))
        rows = F.transform("votes", lambda row, p: F.concat(name(p), F.array_join(F.transform(row, vote_symbol), " ")))
        shown = F.concat(F.array(F.lit(""), F.lit("Visible vote matrix:"), F.concat(F.lit("columns: "), F.array_join(index, " "))), rows)
    masked = F.concat(F.lit("Masked cells: "), F.array_join(F.transform("masked_cells", lambda c: F.concat_ws(",", c[0].cast("string"), c[1].cast("string"))), ", "))
    return F.array_join(F.concat(F.array(*map(F.lit, OPENING)), lines, shown, F.array(F.lit(""), masked, F.lit(""), F.lit(INSTRUCTIONS))), "\n")


def cluster_count() -> Column:
    return F.size(F.array_distinct("clusters"))


def forecast_tasks(snapshots: DataFrame, mode: str = "full", salt: str = ROTATION_SALT) -> DataFrame:
    """Task rows: prompt, answer and info as JSON with sorted keys, and the public snapshot, which leaves out held-out votes and statistics that give them away."""
    prior = matrix.class_prior(matrix.cells(snapshots), "session").withColumnRenamed("session", "session_id")
    public = [c for c in sorted(snapshots.columns) if c not in ("held_out", "stats")]
    info = F.struct(
        cluster_count().alias("cluster_count"), F.size("held_out").alias("masked_vote_count"), F.lit(mode).alias("prompt_mode"), "session_id",
        F.struct(F.col("pa").alias("agree"), F.col("pd").alias("disagree"), F.col("pp").alias("pass")).alias("snapshot_visible_prior"), F.col("meta.synthetic").alias("synthetic"),
    )
    answer = F.map_from_entries(F.array_sort(F.map_entries("held_out")))
    return snapshots.join(prior, "session_id").select(
        F.col("session_id").alias("example_id"), F.array(F.struct(F.lit("user").alias("role"), vote_prompt(mode, salt).alias("content"))).alias("prompt"),
        F.to_json(answer).alias("answer"), F.to_json(info).alias("info"), F.to_json(F.struct(*public)).alias("snapshot"),
    )


def document_view(scenarios: DataFrame, docs_count: int | None = None, docs_length: int | None = None, planted_density: float = 1.0, distractor_density: float = 1.0) -> DataFrame:
    """`scenarios` with `documents` as a difficulty shows them and `visible_items`, the planted items that can still be found.

    The first `docs_count` documents are kept. Contradictions stay only with the whole context.
    Anchors of items and distractors left out by a density are cut from the texts, white space
    is collapsed, and longer texts are cut at `docs_length` without splitting a visible anchor.
    """
    docs = F.slice("documents", 1, docs_count) if docs_count else F.col("documents")
    out = scenarios.withColumn("__docs", docs).withColumn("__ids", F.transform("__docs", lambda d: d["doc_id"]))
    fits = F.lit(True) if docs_length is None else F.forall("documents", lambda d: F.length(d["text"]) <= docs_length)
    whole = (F.size("__docs") == F.size("documents")) & F.lit(planted_density == 1.0) & fits
    here = lambda x: F.array_contains("__ids", x["doc_id"])
    out = out.withColumn("__eligible", F.filter("planted_items", lambda x: here(x) & ((x["type"] != "contradiction") | whole)))
    out = out.withColumn("__chosen", X.density_prefix(F.col("__eligible"), planted_density)).withColumn("__seen", X.density_prefix(F.filter("distractors", here), distractor_density))
    anchor = lambda x: F.struct(x["doc_id"].alias("doc_id"), x["anchor_quote"].alias("anchor"))
    chosen_ids = F.transform("__chosen", lambda x: x["plant_id"])
    lost = F.transform(F.filter("planted_items", lambda x: here(x) & ~F.array_contains(chosen_ids, x["plant_id"])), anchor)
    hidden = F.array_except(F.transform("distractors", anchor), F.transform("__seen", anchor))
    out = out.withColumn("__cut", F.concat(F.array_sort(F.array_distinct(lost)), F.array_sort(hidden)))
    cleared = lambda d: X.collapsed(F.aggregate(F.filter("__cut", lambda c: c["doc_id"] == d["doc_id"]), d["text"], lambda t, c: F.replace(t, c["anchor"], F.lit(""))))
    shown = F.concat(F.transform("__chosen", anchor), F.transform("__seen", anchor))
    text = cleared if docs_length is None else lambda d: truncated(cleared(d), docs_length, F.transform(F.filter(shown, lambda a: a["doc_id"] == d["doc_id"]), lambda a: a["anchor"]))
    out = out.withColumn("documents", F.transform("__docs", lambda d: d.withField("text", text(d))))
    found = F.filter("__chosen", lambda x: F.exists("documents", lambda d: (d["doc_id"] == x["doc_id"]) & F.contains(d["text"], x["anchor_quote"])))
    return out.withColumn("visible_items", found).drop("__docs", "__ids", "__eligible", "__chosen", "__seen", "__cut")


def truncated(text: Column, limit: int, anchors: Column) -> Column:
    """A text cut at `limit` with an ellipsis; the cut moves left out of every anchor it would split, until it splits none."""
    def earlier(cut: Column, _: Column) -> Column:
        starts = F.transform(anchors, lambda a: F.struct(F.position(a, text).alias("at"), F.length(a).alias("n")))
        split = F.filter(starts, lambda x: (x["at"] > 0) & (x["at"] - 1 < cut) & (x["at"] - 1 + x["n"] > cut))
        return F.when(F.size(split) > 0, F.array_min(F.transform(split, lambda x: x["at"] - 1))).otherwise(cut)

    cut = F.aggregate(F.sequence(F.lit(0), F.size(anchors)), F.lit(limit), earlier)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), cut)), F.lit("…")))
