"""Scenario operators as queries: finding edges from quotes, question metrics, panel arithmetic, document views.

Documents and order lines stand in for scenarios; both engines derive the same inputs from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenara.functions import text as X
from plenara.operators import matching, prompts, validate, views
from plenara.plans import findings

#: Registered by plenara.queries.
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- findings from quotes --------------------------------------------------------------------

KINDS = ("ambiguity", "contradiction", "gap")
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_SIGNED = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace(lower(coalesce(@T, '')), 'ß', 'ss'), '-([ \t\n\x0B\f\r]*[0-9])', chr(1) || '\1', 'g'),
  '([!~])([ \t\n\x0B\f\r]*[\p{L}\p{N}])', chr(2) || '\1\2', 'g'), '!=|<=|>=|==|\x02[!~]|\x01|[\p{L}\p{N}]+|[¬≠≤≥=<>±+−%$€£¥∉∈∧∨]'), lambda x: CASE WHEN x = chr(1) THEN '-' ELSE replace(x, chr(2), '') END)"""


def _tokens(text: str) -> str:
    """SQL: a text's words and the signs that carry meaning, lower-cased."""
    return _SIGNED.replace("@T", text)


def _documents(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("task")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("task", "text", X.sentences(F.col("text")).alias("s")).where(F.size("s") >= 5)


def _found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Candidates and items: the first sentences of each document, as they are and changed in the ways that matter."""
    docs, kind = _documents(spark, sf_dir), lambda k: F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.col("task") + k, F.lit(3)) + 1).cast("int"))
    place = lambda q: F.struct(F.lit("d").alias("doc_id"), q.alias("quote"))
    none = F.lit(None).cast("struct<doc_id:string,quote:string>")
    s = lambda k: F.col("s")[k]
    rows = []
    for k in range(3):
        related = F.when(kind(k) == "contradiction", place(s(k + 2))).otherwise(none)
        rows.append(F.struct(F.lit(k).alias("item"), F.lit("d").alias("doc_id"), s(k).alias("quote"), kind(k).alias("type"), related.alias("related_evidence")))
    items = docs.select("task", "text", F.explode(F.array(*rows)).alias("x")).select("task", "x.*", F.col("text").alias("document"), F.col("text").alias("related_document"))
    asks = lambda c: F.when(c, F.lit("Should the rule hold?")).otherwise(F.lit("Hold the rule?"))
    odd = F.col("task") % 2 == 1
    shorter = F.regexp_replace(s(1), r"\s+\S+$", "")
    turned = F.col("task") % 3 == 1
    said = [
        (F.upper(s(0)), kind(0), asks(F.lit(True)), F.when(kind(0) == "contradiction", place(s(2))).otherwise(none), F.lit("d")),
        (shorter, kind(1), asks(odd), F.when(odd, place(s(3))).otherwise(none), F.lit("d")),
        (F.when(turned, s(4)).otherwise(s(2)), F.when(odd, kind(2)).otherwise(F.lit("gap")), asks(F.lit(True)), F.when(kind(2) == "contradiction", place(s(2))).otherwise(none), F.lit("d")),
        (F.concat(s(0), F.lit(" "), s(1)), kind(0), asks(F.lit(True)), none, F.lit("d")),
        (s(1), kind(1), asks(F.lit(True)), F.when(kind(1) == "contradiction", place(s(3))).otherwise(none), F.when(odd, F.lit("d")).otherwise(F.lit("e"))),
    ]
    made = [F.struct(F.lit(k).alias("cand"), q.alias("quote"), t.alias("type"), d.alias("diagnosis"), r.alias("related_evidence"), w.alias("doc_id")) for k, (q, t, d, r, w) in enumerate(said)]
    return docs.select("task", F.explode(F.array(*made)).alias("x")).select("task", "x.*"), items


_KIND = lambda k: f"['ambiguity', 'contradiction', 'gap'][(task + {k}) % 3 + 1]"
_FOUND = rf"""WITH d AS (SELECT task, text, {_SENTENCES} AS s FROM (SELECT doc_id AS task, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)),
doc AS (SELECT *, task % 2 = 1 AS odd, task % 3 = 1 AS turned FROM d WHERE len(s) >= 5),
item AS (
  {" UNION ALL ".join(f"SELECT task, text, {k} AS item, 'd' AS doc_id, s[{k + 1}] AS quote, {_KIND(k)} AS type, CASE WHEN {_KIND(k)} = 'contradiction' THEN s[{k + 3}] END AS related FROM doc" for k in range(3))}),
cand AS (
  SELECT task, 0 AS cand, upper(s[1]) AS quote, {_KIND(0)} AS type, true AS asks, CASE WHEN {_KIND(0)} = 'contradiction' THEN s[3] END AS related, 'd' AS doc_id FROM doc
  UNION ALL SELECT task, 1, regexp_replace(s[2], '[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]+$', ''), {_KIND(1)}, odd, CASE WHEN odd THEN s[4] END, 'd' FROM doc
  UNION ALL SELECT task, 2, CASE WHEN turned THEN s[5] ELSE s[3] END, CASE WHEN odd THEN {_KIND(2)} ELSE 'gap' END, true, CASE WHEN {_KIND(2)} = 'contradiction' THEN s[3] END, 'd' FROM doc
  UNION ALL SELECT task, 3, s[1] || ' ' || s[2], {_KIND(0)}, true, NULL, 'd' FROM doc
  UNION ALL SELECT task, 4, s[2], {_KIND(1)}, true, CASE WHEN {_KIND(1)} = 'contradiction' THEN s[4] END, CASE WHEN odd THEN 'd' ELSE 'e' END FROM doc),
side AS (
  SELECT task, item, type, 'own' AS side, {_tokens("quote")} AS q, {_tokens("text")} AS t FROM item
  UNION ALL SELECT task, item, type, 'reversed', {_tokens("related")}, {_tokens("text")} FROM item WHERE related IS NOT NULL),
said AS (
  SELECT task, cand, 'own' AS what, {_tokens("quote")} AS q FROM cand WHERE doc_id = 'd'
  UNION ALL SELECT task, cand, 'related', {_tokens("related")} FROM cand WHERE related IS NOT NULL),
pair AS (SELECT said.task, cand, what, item, side, said.q AS a, side.q AS b, t FROM said JOIN side ON said.task = side.task),
ta AS (SELECT task, cand, what, unnest(q) AS w, unnest(range(len(q))) AS i FROM said), tb AS (SELECT task, item, side, unnest(q) AS w, unnest(range(len(q))) AS j FROM side),
isle AS (SELECT ta.task, cand, what, item, side, i - j AS dg, i - row_number() OVER (PARTITION BY ta.task, cand, what, item, side, i - j ORDER BY i) AS g FROM ta JOIN tb ON ta.task = tb.task AND ta.w = tb.w),
span AS (SELECT task, cand, what, item, side, max(n) AS n FROM (SELECT task, cand, what, item, side, dg, g, count(*) AS n FROM isle GROUP BY ALL) GROUP BY ALL),
hit AS (SELECT task, cand, what, item, side FROM pair JOIN span USING (task, cand, what, item, side)
  WHERE n >= 0.9 * len(b) AND n >= 0.8 * len(a) AND 2 * n >= 0.8 * (len(a) + len(b)) AND contains(chr(1) || array_to_string(t, chr(1)) || chr(1), chr(1) || array_to_string(a, chr(1)) || chr(1))),
edge AS (SELECT h.task, h.cand, h.item, c.type = i.type AS typed, c.type = i.type AND asks AS diagnosed,
    c.type = i.type AND asks AND CASE WHEN i.type = 'contradiction' THEN EXISTS (SELECT 1 FROM hit r WHERE r.task = h.task AND r.cand = h.cand AND r.item = h.item AND r.what = 'related' AND r.side <> h.side) ELSE c.related IS NULL END AS related
  FROM hit h JOIN cand c ON c.task = h.task AND c.cand = h.cand JOIN item i ON i.task = h.task AND i.item = h.item WHERE h.what = 'own')"""


@_query(_FOUND + " SELECT task, cand::INTEGER AS cand, item::INTEGER AS item, true AS localized, bool_or(typed) AS typed, bool_or(diagnosed) AS diagnosed, bool_or(related) AS related FROM edge GROUP BY task, cand, item")
def finding_edges(spark, sf_dir):
    """Which of five submitted findings of every document meet which of its three planted ones, stage by stage."""
    return findings.finding_edges(*_found(spark, sf_dir)).select("task", "cand", "item", "localized", "typed", "diagnosed", "related")


# --- questions -------------------------------------------------------------------------------

FACTIONS = ("f1", "f2", "f3")
STANCES = ("agree", "disagree", "pass")
_LINE = "li AS (SELECT l_orderkey AS task, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS k, min(l_quantity) AS q FROM lineitem GROUP BY ALL)"
POLARIZATION = 0.5


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as tasks: all lines as items, the first three again as questions, changed in the ways that matter."""
    li = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("n"))
    li = li.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("k"), F.min("l_quantity").alias("q"))
    text = lambda c: c.cast("string")
    stance = lambda i: F.element_at(F.array(*map(F.lit, STANCES)), (F.pmod(F.col("p") + i * F.col("k"), F.lit(3)) + 1).cast("int"))
    swapped = lambda c: F.when(c == "agree", "disagree").when(c == "disagree", "agree").otherwise(c)
    stances = lambda of: F.create_map(*[x for i, f in enumerate(FACTIONS) for x in (F.lit(f), of(i))])
    frame = lambda actor: F.struct(actor.alias("actor"), F.lit("decides").alias("action"), text(F.col("k")).alias("condition"), F.lit("a").alias("anchor_outcome"), F.lit("b").alias("alternative_outcome"))
    related = F.when(F.col("p") % 4 == 0, F.struct(F.lit("d9").alias("doc_id"), F.concat(F.lit("Other "), text(F.col("k"))).alias("quote"))).otherwise(F.lit(None).cast("struct<doc_id:string,quote:string>"))
    kind = F.when(F.col("p") % 4 == 0, "contradiction").otherwise("gap")
    choice = F.when(F.col("k") % 2 == 0, "anchor").otherwise("alternative")
    quote, doc = F.concat(F.lit("The Rule "), text(F.col("p"))), F.concat(F.lit("d"), text(F.col("n") % 2))
    alternative = stances(stance)
    items = li.select(
        "task", F.col("n").cast("int").alias("item"), doc.alias("doc_id"), quote.alias("quote"), kind.alias("type"), related.alias("related_evidence"), frame(F.lit("The Board")).alias("decision"),
        alternative.alias("alternative_stances"), matching.oriented_stances(alternative, choice).alias("target_stances"), (F.col("q") / 50).alias("decision_value"),
    )
    way = F.col("p") % 7
    said = F.when(way == 1, F.concat(F.lit(" the  RULE "), text(F.col("p")))).when(way == 2, F.concat(F.lit("The Rule "), text(F.col("p") + 1))).otherwise(quote)
    question = F.when(way == 3, "Hold it?").otherwise("Should it hold?")
    told = lambda i: F.when((way == 4) & F.lit(i == 0), F.lit("pass")).otherwise(F.when(choice == "anchor", swapped(stance(i))).otherwise(stance(i)))
    first = li.where("n <= 3")
    candidates = first.select(
        "task", (F.col("n") - 1).cast("int").alias("cand"), doc.alias("doc_id"), said.alias("quote"), F.when(way == 5, "ambiguity").otherwise(kind).alias("type"), question.alias("question"),
        frame(F.when(way == 6, "a board").otherwise("THE  board")).alias("decision"), choice.alias("yes_choice"), related.alias("related_evidence"), stances(told).alias("target_stances"),
    )
    return candidates, items


_ST = lambda i, p="p", k="k": f"['agree', 'disagree', 'pass'][({p} + {i} * {k}) % 3 + 1]"
_SWAP = lambda x: f"CASE {x} WHEN 'agree' THEN 'disagree' WHEN 'disagree' THEN 'agree' ELSE 'pass' END"
_ORIENTED = lambda i, choice, p="p", k="k": f"CASE WHEN {choice} = 'anchor' THEN {_SWAP(_ST(i, p, k))} ELSE {_ST(i, p, k)} END"
_H = lambda c: f"CASE WHEN {c} > 0 THEN -({c} / 3) * ln({c} / 3) ELSE 0 END"
_ASKED = f"""WITH {_LINE},
it AS (SELECT task, n AS item, n % 2 AS doc, p, k, p % 4 = 0 AS con, CASE WHEN k % 2 = 0 THEN 'anchor' ELSE 'alternative' END AS choice, q / 50 AS dv FROM li),
ts AS (SELECT *, [{", ".join(_ORIENTED(i, "choice") for i in range(3))}] AS ts FROM it),
ct AS (SELECT *, len(list_filter(ts, lambda x: x = 'agree')) AS a, len(list_filter(ts, lambda x: x = 'disagree')) AS d, len(list_filter(ts, lambda x: x = 'pass')) AS o FROM ts),
ws AS (SELECT *, dv * ({1 - POLARIZATION} + {POLARIZATION} * ((({_H("a")}) + ({_H("d")}) + ({_H("o")})) / ln(3) + 1 - (a * (a - 1) + d * (d - 1) + o * (o - 1)) / 6) / 2) AS worth FROM ct),
cd AS (SELECT task, n - 1 AS cand, n % 2 AS doc, p, k, p % 4 = 0 AS con, p % 7 AS way, CASE WHEN k % 2 = 0 THEN 'anchor' ELSE 'alternative' END AS choice FROM li WHERE n <= 3),
cs AS (SELECT *, [CASE WHEN way = 4 THEN 'pass' ELSE {_ORIENTED(0, "choice")} END, {_ORIENTED(1, "choice")}, {_ORIENTED(2, "choice")}] AS said FROM cd),
pr AS (SELECT c.task, cand, item, worth,
    c.doc = i.doc AND (CASE WHEN way = 5 THEN 'ambiguity' WHEN c.con THEN 'contradiction' ELSE 'gap' END) = (CASE WHEN i.con THEN 'contradiction' ELSE 'gap' END)
      AND (CASE WHEN way = 2 THEN c.p + 1 ELSE c.p END) = i.p AND (NOT c.con AND NOT i.con OR c.con AND i.con AND c.k = i.k) AS evidence,
    way NOT IN (3, 6) AND c.k = i.k AS asks,
    len(list_filter([1, 2, 3], lambda f: said[f] = [{", ".join(_ORIENTED(i, "c.choice", "i.p", "i.k") for i in range(3))}][f])) AS correct
  FROM cs c JOIN ws i ON c.task = i.task),
pw AS (SELECT *, evidence AND asks AS grounded, CASE WHEN evidence AND asks THEN (0.5 + 0.5 * correct / 3) * worth ELSE 0 END AS weight FROM pr),
sz AS (SELECT task, count(*) FILTER (n <= 3) AS nc FROM li GROUP BY task),
top AS (SELECT task, item, worth FROM (SELECT ws.*, row_number() OVER (PARTITION BY task ORDER BY worth DESC, item) AS r FROM ws) WHERE r <= 3),
pick AS (SELECT task, item FROM (SELECT ws.*, row_number() OVER (PARTITION BY task ORDER BY worth DESC, 'd' || doc, 'The Rule ' || p) AS r FROM ws) WHERE r <= 3),
most AS (SELECT task, sum(worth) AS most FROM top GROUP BY task),
o1 AS (SELECT task, cand, item, weight, correct, grounded, evidence, evidence AND EXISTS (SELECT 1 FROM pick WHERE pick.task = pw.task AND pick.item = pw.item) AS chosen FROM pw),
op AS (SELECT * FROM o1 UNION ALL SELECT task, c, NULL, 0, 0, true, true, true FROM sz, (VALUES (0), (1), (2)) v(c)),
al AS (SELECT a.task, a.item AS x, b.item AS y, c.item AS z, a.weight + b.weight + c.weight AS weight, a.grounded AND b.grounded AND c.grounded AS g, a.evidence AND b.evidence AND c.evidence AS e, a.chosen AND b.chosen AND c.chosen AS t,
    (a.item IS NOT NULL)::INT + (b.item IS NOT NULL)::INT + (c.item IS NOT NULL)::INT AS n, a.correct + b.correct + c.correct AS correct,
    list_filter([CASE WHEN a.item IS NOT NULL THEN [0, a.item] END, CASE WHEN b.item IS NOT NULL THEN [1, b.item] END, CASE WHEN c.item IS NOT NULL THEN [2, c.item] END], lambda w: w IS NOT NULL) AS pairs
  FROM op a JOIN op b ON a.task = b.task AND a.cand = 0 AND b.cand = 1 AND (a.item IS NULL OR b.item IS NULL OR a.item <> b.item) JOIN op c ON c.task = a.task AND c.cand = 2 AND (c.item IS NULL OR (a.item IS NULL OR c.item <> a.item) AND (b.item IS NULL OR c.item <> b.item))),
ut AS (SELECT task, max(weight) AS best FROM al GROUP BY task),
gr AS (SELECT task, n, correct FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, correct DESC, pairs) AS r FROM al WHERE g) WHERE r = 1),
ev AS (SELECT task, n, correct FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, correct DESC, pairs) AS r FROM al WHERE e) WHERE r = 1),
tp AS (SELECT task, n FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, correct DESC, pairs) AS r FROM al WHERE t) WHERE r = 1)
SELECT task, round(CASE WHEN nc = 3 AND most > 0 THEN least(1, best / most) ELSE 0 END, 6) AS utility, (nc = 3)::DOUBLE AS format_validity, round(CASE WHEN nc = 3 THEN gr.n / 3 ELSE 0 END, 6) AS grounding_recall,
  round(CASE WHEN nc = 3 THEN gr.correct / 9 ELSE 0 END, 6) AS grounded_stance_recall, round(CASE WHEN nc = 3 THEN ev.n / 3 ELSE 0 END, 6) AS evidence_match_recall,
  round(CASE WHEN nc = 3 AND ev.n > 0 THEN ev.correct / (3 * ev.n) ELSE 0 END, 6) AS evidence_matched_stance_accuracy, round(CASE WHEN nc = 3 THEN tp.n / 3 ELSE 0 END, 6) AS top_selection_accuracy
FROM sz JOIN most USING (task) JOIN ut USING (task) JOIN gr USING (task) JOIN ev USING (task) JOIN tp USING (task)"""


@_query(_ASKED)
def question_metrics(spark, sf_dir):
    """Three questions an order against all of its lines: utility by the best assignment, and the companion metrics."""
    out = findings.question_metrics(*_asked(spark, sf_dir), POLARIZATION, 3)
    return out.select("task", *[F.round(c, 6).alias(c) for c in out.columns if c != "task"])


# --- panels ----------------------------------------------------------------------------------

_DIM = len(validate.DIMENSIONS)
_VALUE = lambda f, d: f"((p_partkey * {f + 2} + {d * 7 + f}) % 21 - 10) / 10.0"
_WEIGHT = lambda d: f"((p_size * {d + 3} + p_partkey) % 21 - 10) / 10.0"


def _panel(spark, sf_dir) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    struct = lambda of: F.struct(*[F.expr(f"cast({of(d)} AS double)").alias(name) for d, name in enumerate(validate.DIMENSIONS)])
    rows = parts.select("p_partkey", struct(_WEIGHT).alias("weights"), F.array(*[struct(lambda d, f=f: _VALUE(f, d)) for f in range(4)]).alias("values"))
    return rows.withColumn("preferences", F.transform("values", lambda v: validate.preference(v, F.col("weights"))))


_PREF = lambda f: f"CASE WHEN below > 0 THEN ({' + '.join(f'({_VALUE(f, d)})::DOUBLE * ({_WEIGHT(d)})::DOUBLE' for d in range(_DIM))}) / below ELSE 0 END"


@_query(f"""WITH b AS (SELECT *, {" + ".join(f"abs(({_WEIGHT(d)})::DOUBLE)" for d in range(_DIM))} AS below FROM part), p AS (SELECT p_partkey, [{", ".join(_PREF(f) for f in range(4))}] AS pr FROM b),
s AS (SELECT *, list_transform(pr, lambda x: CASE WHEN x >= 0.25 THEN 'agree' WHEN x <= -0.25 THEN 'disagree' ELSE 'pass' END) AS st, sqrt(list_sum(list_transform(pr, lambda x: x * x)) / 4) * (list_max(pr) - list_min(pr)) / 2 AS m FROM p),
c AS (SELECT *, len(list_filter(st, lambda x: x = 'agree')) AS a, len(list_filter(st, lambda x: x = 'disagree')) AS d, len(list_filter(st, lambda x: x = 'pass')) AS o FROM s),
g AS (SELECT *, ((CASE WHEN a > 0 THEN -(a / 4) * ln(a / 4) ELSE 0 END + CASE WHEN d > 0 THEN -(d / 4) * ln(d / 4) ELSE 0 END + CASE WHEN o > 0 THEN -(o / 4) * ln(o / 4) ELSE 0 END) / ln(3) + 1 - (a * (a - 1) + d * (d - 1) + o * (o - 1)) / 12) / 2 AS dis,
    least(1.0, greatest(2.0 ** -52, 4 * m * m)) AS worth FROM c)
SELECT p_partkey, array_to_string(st, ',') AS stances, round(pr[1], 6) + 0.0 AS first, round(worth, 6) AS decision_value, round(dis, 6) + 0.0 AS disagreement, round(worth * (0.25 + 0.75 * dis), 6) AS attainable FROM g""")
def panel_preferences(spark, sf_dir):
    """Four factions' stands on an issue made of every part: stances, decision value, disagreement, what a question is worth."""
    rows = _panel(spark, sf_dir).withColumn("stances", F.transform("preferences", validate.stance)).withColumn("worth", validate.tradeoff_value(F.col("preferences")))
    by = F.map_from_arrays(F.array(*map(F.lit, ("f1", "f2", "f3", "f4"))), F.col("stances"))
    rows = rows.withColumn("dis", matching.stance_disagreement(by))
    attainable = matching.attainable(F.col("worth"), F.col("dis"), 0.75)
    return rows.select(
        "p_partkey", F.array_join("stances", ",").alias("stances"), (F.round(F.col("preferences")[0], 6) + 0.0).alias("first"), F.round("worth", 6).alias("decision_value"),
        (F.round("dis", 6) + 0.0).alias("disagreement"), F.round(attainable, 6).alias("attainable"),
    )


# --- document views --------------------------------------------------------------------------

COUNT, LENGTH, PLANTED, DISTRACTING = 3, 300, 0.5, 0.5


def _scenarios(spark, sf_dir) -> DataFrame:
    """Four documents a scenario: the first sentence of each is planted, the second distracts."""
    docs = _documents(spark, sf_dir).withColumn("scenario_id", F.expr("task div 4")).withColumn("doc_id", F.concat(F.lit("d"), (F.col("task") % 4).cast("string")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.col("task"), F.lit(3)) + 1).cast("int"))
    row = F.struct("doc_id", "text", kind.alias("type"), F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    by = docs.groupBy("scenario_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return by.select(
        "scenario_id", F.transform("r", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["text"].alias("text"))).alias("documents"),
        F.transform("r", lambda x: F.struct(x["doc_id"].alias("plant_id"), x["doc_id"].alias("doc_id"), x["a"].alias("anchor_quote"), x["type"].alias("type"))).alias("planted_items"),
        F.transform("r", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["b"].alias("anchor_quote"))).alias("distractors"),
    )


def _view_sql(count: int, length: int, planted: float, distracting: float) -> str:
    blank = r"[ \t\n\x0B\f\r\x{85}\p{Z}\x1c-\x1f]+"
    cut = lambda c: f"coalesce(list_min(list_transform(list_filter(shown, lambda a: instr(cleared, a) > 0 AND instr(cleared, a) - 1 < {c} AND instr(cleared, a) - 1 + length(a) > {c}), lambda a: instr(cleared, a) - 1)), {c})"
    return rf"""WITH d AS (SELECT task, text, {_SENTENCES} AS s FROM (SELECT doc_id AS task, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)),
r AS (SELECT task // 4 AS scenario_id, 'd' || (task % 4) AS doc_id, text, s[1] AS a, s[2] AS b, {_KIND(0)} AS type FROM d WHERE len(s) >= 5),
n AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY scenario_id) AS of, max(length(text)) OVER (PARTITION BY scenario_id) AS longest FROM r),
h AS (SELECT *, type <> 'contradiction' OR (of <= {count} AND {planted} = 1 AND longest <= {length}) AS eligible FROM n WHERE k <= {count}),
o AS (SELECT *, sum(eligible::INT) OVER (PARTITION BY scenario_id ORDER BY k) AS ek, sum(eligible::INT) OVER (PARTITION BY scenario_id) AS en, count(*) OVER (PARTITION BY scenario_id) AS hn FROM h),
c AS (SELECT *, eligible AND ek <= least(en, greatest(1, ceil(en * {planted}))) AS chosen, k <= least(hn, greatest(1, ceil(hn * {distracting}))) AS seen FROM o),
l AS (SELECT *, list_concat(CASE WHEN chosen THEN [] ELSE [a] END, CASE WHEN seen THEN [] ELSE [b] END) AS gone, list_concat(CASE WHEN chosen THEN [a] ELSE [] END, CASE WHEN seen THEN [b] ELSE [] END) AS shown FROM c),
x AS (SELECT *, CASE len(gone) WHEN 0 THEN text WHEN 1 THEN replace(text, gone[1], '') ELSE replace(replace(text, gone[1], ''), gone[2], '') END AS t FROM l),
w AS (SELECT *, trim(regexp_replace(t, '{blank}', ' ', 'g')) AS cleared FROM x), c1 AS (SELECT *, {cut(str(length))} AS q1 FROM w), c2 AS (SELECT *, {cut("q1")} AS q2 FROM c1), c3 AS (SELECT *, {cut("q2")} AS q3 FROM c2),
v AS (SELECT *, CASE WHEN length(cleared) <= {length} THEN cleared ELSE rtrim(left(cleared, q3)) || '…' END AS shows FROM c3)
SELECT scenario_id, doc_id, shows AS text, chosen AND contains(shows, a) AS planted FROM v"""


@_query(_view_sql(COUNT, LENGTH, PLANTED, DISTRACTING))
def document_views(spark, sf_dir):
    """Scenarios of four documents as a difficulty shows them: three documents, half of the items and distractors, texts cut short."""
    seen = views.document_view(_scenarios(spark, sf_dir), COUNT, LENGTH, PLANTED, DISTRACTING)
    found = F.transform("visible_items", lambda x: x["plant_id"])
    return seen.select("scenario_id", F.explode("documents").alias("d"), found.alias("found")).select("scenario_id", "d.doc_id", "d.text", F.array_contains("found", F.col("d.doc_id")).alias("planted"))


# --- prompts ---------------------------------------------------------------------------------

QUESTIONS, POLARIZED = 2, 0.75
_FACTIONS = (("f1", "Staff", "who work here"), ("f2", "Visitors", "who come by"), ("f3", "Neighbours", "who live near"))
_WEIGHTS = dict(zip(validate.DIMENSIONS, (0.5, -0.25, 0.0, 1.0, 0.125), strict=True))


def _prompted(spark, sf_dir) -> DataFrame:
    """Scenarios of four documents with three factions; the decision of each document's item names the document."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    frame = lambda x: F.struct(
        F.lit("the board").alias("actor"), text("decides on ", x["doc_id"]).alias("action"), F.lit("in doubt").alias("condition"), F.lit("it stands").alias("anchor_outcome"), F.lit("it changes").alias("alternative_outcome"),
    )
    weights = F.struct(*[F.lit(w).alias(d) for d, w in _WEIGHTS.items()])
    return _scenarios(spark, sf_dir).select(
        "scenario_id", F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("faction_id", "name", "summary"), f, strict=True)]) for f in _FACTIONS]).alias("factions"),
        F.transform("documents", lambda d: F.struct(d["doc_id"], text("Rules ", d["doc_id"]).alias("title"), F.lit("memo").alias("style"), d["text"].alias("text"))).alias("documents"),
        F.transform("planted_items", lambda x: F.struct(frame(x).alias("decision"), weights.alias("value_weights"))).alias("visible_items"),
    )


def _said(lines) -> str:
    """Lines of a prompt as a SQL text."""
    return "'" + "\n".join(lines).replace("'", "''") + "'"


_SHOWN = "string_agg(chr(10) || '[' || doc_id || '] Rules ' || doc_id || ' (memo)' || chr(10) || text, chr(10) ORDER BY doc_id)"
_WEIGHED = "{" + ",".join(f'"{d}":{_WEIGHTS[d]}' for d in sorted(_WEIGHTS)) + "}"
_PROFILE = (
    """'{"alternative_tradeoff_weights":""" + _WEIGHED + ""","decision":{"action":"decides on ' || doc_id || '","actor":"the board","alternative_outcome":"it changes","anchor_outcome":"it stands","condition":"in doubt"}}'"""
)


@_query(rf"""WITH d AS (SELECT task, text, {_SENTENCES} AS s FROM (SELECT doc_id AS task, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)),
r AS (SELECT task // 4 AS scenario_id, 'd' || (task % 4) AS doc_id, text FROM d WHERE len(s) >= 5),
g AS (SELECT scenario_id, {_SHOWN} AS docs, '[' || string_agg({_PROFILE}, ',' ORDER BY doc_id) || ']' AS profiles FROM r GROUP BY 1),
f AS (SELECT {_said([f"[{i}] {n}: {t}" for i, n, t in _FACTIONS])} AS factions)
SELECT scenario_id, 'find' AS task, sha256({_said(prompts.FIND_OPENING)} || chr(10) || factions || chr(10) || chr(10) || 'Documents:' || chr(10) || docs || chr(10) || chr(10) || {_said(prompts.find_closing(QUESTIONS))}) AS prompt_sha256 FROM g, f
UNION ALL SELECT scenario_id, 'ask', sha256({_said(prompts.ask_opening(QUESTIONS, POLARIZED, 0.25))} || chr(10) || factions || chr(10) || chr(10) || 'Candidate decision profiles (unordered; one per possible issue):' || chr(10) || profiles
  || chr(10) || chr(10) || 'Documents:' || chr(10) || docs || chr(10) || chr(10) || {_said(prompts.ASK_CLOSING)}) FROM g, f""")
def scenario_prompts(spark, sf_dir):
    """Both prompts of scenarios made of four documents each."""
    rows, out = _prompted(spark, sf_dir), None
    for task, prompt in (("find", prompts.find_prompt(QUESTIONS)), ("ask", prompts.ask_prompt(QUESTIONS, POLARIZED))):
        part = rows.select("scenario_id", F.lit(task).alias("task"), F.sha2(prompt, 256).alias("prompt_sha256"))
        out = part if out is None else out.unionByName(part)
    return out


# --- identities ------------------------------------------------------------------------------

_CLEAN = r"trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[ \t\n\x0B\f\r\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'))"
@_query(f"""SELECT doc_id, sha256({_CLEAN}) AS identity, sha256(nfc_normalize(coalesce(text, ''))) AS fingerprint, sha256(array_to_string({_tokens("text")}, ' ')) AS tokens, len({_tokens("text")})::INTEGER AS n_tokens FROM documents""")
def text_identities(spark, sf_dir):
    """The forms in which texts are compared: case-folded text, NFC text, words with the signs that carry meaning."""
    text = F.coalesce("text", F.lit(""))
    tokens = X.contract_tokens(text)
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(X.anchor_identity(text), 256).alias("identity"), F.sha2(X.question_fingerprint(text), 256).alias("fingerprint"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens"), F.size(tokens).alias("n_tokens"),
    )
