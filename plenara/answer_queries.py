"""Answer contracts as queries: texts built from every event, read by the strict decoders, held against rules in SQL.

The texts are the same expressions in both engines, so that the SQL computes from what was
written what the decoder must say of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plenara.functions import strict_json as J
from plenara.functions import text as X

#: Registered by plenara.queries.
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props", "user_id")


def _variants(cases: list[str]) -> str:
    """A SQL expression, the same for Spark and DuckDB, that gives each event the text of its turn."""
    return "CASE " + " ".join(f"WHEN event_id % {len(cases)} = {k} THEN {c}" for k, c in enumerate(cases)) + " END"


def _raw(f):
    """Spark reads backslashes in SQL strings as they stand while a query's expressions are parsed."""
    def run(spark, sf_dir):
        old = spark.conf.get("spark.sql.parser.escapedStringLiterals")
        spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
        try:
            return f(spark, sf_dir)
        finally:
            spark.conf.set("spark.sql.parser.escapedStringLiterals", old)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


#: SQL macros over a text t: without blanks and fence; without strings; brackets only; whether it is one strict value.
_BARE = r"trim(regexp_replace(trim({t}, chr(32) || chr(9) || chr(10) || chr(13)), '^```(?:json)?[ \t]*\r?\n(.*)```$', '\1', 'is'), chr(32) || chr(9) || chr(10) || chr(13))"
_QUIET = r"""regexp_replace({t}, '"([^"\\]|\\.)*"', '""', 'gs')"""
_DEEP = r"""coalesce(list_max(list_transform(range(1, len({q}) + 1), lambda i: len(regexp_replace({q}[1:i], '[^\[{{]', '', 'g')) - len(regexp_replace({q}[1:i], '[^\]}}]', '', 'g')))), 0)"""


def _strict_sql(text: str, extra: str = "") -> str:
    """CTEs: e has event_id and bare; x adds strict, whether bare is one JSON object within the bounds."""
    quiet = _QUIET.format(t="bare")
    brackets = "regexp_replace(quiet, '[^][{}]', '', 'g')"
    return f"""WITH e0 AS (SELECT event_id, user_id, {text} AS t FROM events), e1 AS (SELECT *, {_BARE.format(t="t")} AS bare FROM e0),
e2 AS (SELECT *, {quiet} AS quiet FROM e1), e3 AS (SELECT *, {brackets} AS br FROM e2), e4 AS (SELECT *, {_DEEP.format(q="br")} AS deep FROM e3),
x AS (SELECT event_id, user_id, t, bare, coalesce(json_valid(bare) AND json_type(CASE WHEN json_valid(bare) THEN bare END) = 'OBJECT' AND NOT regexp_matches(quiet, 'NaN|Infinity|,[ \t\r\n]*[]}}]') AND deep <= {J.ANSWER_DEPTH}
  AND len(t) <= {J.ANSWER_CHARS}{extra}, false) AS strict FROM e4)"""


def _unique_keys(*paths: str) -> str:
    """SQL: no object at these paths has a key twice."""
    js = "CASE WHEN json_valid(bare) THEN bare END"
    return "".join(f" AND coalesce(len(json_keys({js}, '{p}')) = len(list_distinct(json_keys({js}, '{p}'))), true)" for p in paths)


_OBJECTS = _variants([
    "props", "concat(substring(props, 1, length(props) - 1), ', \"k\": 1}')", "concat(substring(props, 1, length(props) - 1), ', \"x\": NaN}')", "concat(props, ' x')",
    "concat('```json', chr(10), props, chr(10), '```')", "concat(' ', chr(10), props, chr(9))", "concat('[', props, ']')",
    f"concat('{{\"n\":', repeat('[', {J.ANSWER_DEPTH - 1}), cast(event_id AS varchar(20)), repeat(']', {J.ANSWER_DEPTH - 1}), '}}')", f"concat('{{\"n\":', repeat('[', {J.ANSWER_DEPTH}), repeat(']', {J.ANSWER_DEPTH}), '}}')",
    "concat('{\"n\":{\"a\":1,\"a\":2}}')", "concat('{\"n\":\"', repeat('[{', 40), '\"}')", f"concat('{{\"n\":\"', repeat('x', {J.ANSWER_CHARS - 8} + cast(event_id % 3 AS int)), '\"}}')",
    "concat('{\"n\":', cast(event_id AS varchar(20)), ',}')", "concat('```', chr(10), props, chr(10), '``` end')",
])


@_query(_strict_sql(_OBJECTS, _unique_keys("$", "$.n")) + " SELECT event_id, strict FROM x")
@_raw
def json_contract(spark, sf_dir):
    """Strictness of objects made of every event's props: fences, repeated keys, no numbers, depth, length, what follows."""
    e = _events(spark, sf_dir).withColumn("t", F.expr(_OBJECTS))
    return e.select("event_id", J.canonical_answer(F.col("t")).isNotNull().alias("strict"))


_FINDING = "'{\"doc_id\":\"d', cast(user_id AS varchar(20)), '\",\"quote\":\"{q}\",\"type\":\"{t}\",\"diagnosis\":\"{d}\",\"related_evidence\":{r}{x}}}'"


def _finding(q: str = "The Rule, holds", t: str = "gap", d: str = "Is it so?", r: str = "null", x: str = "") -> str:
    return _FINDING.replace("{q}", q).replace("{t}", t).replace("{d}", d).replace("{r}", r).replace("{x}", x).replace("}}", "}")


def _list(name: str, *items: str, after: str = "}") -> str:
    return "concat('{\"" + name + "\":[', " + ", ',', ".join(items) + f", ']{after}')"


_REL = '{"doc_id":"d2","quote":"other"}'
_FINDINGS = _variants([
    _list("findings", _finding()), _list("findings", _finding(t="contradiction", r=_REL), _finding(q="A second")), _list("findings", _finding(t="typo")), _list("findings", _finding(q=" ")),
    _list("findings", _finding(), _finding(q="the RULE holds!")), _list("findings", _finding(x=',"more":1')), _list("findings", _finding(r='{"doc_id":"d2"}')), _list("findings", _finding(r='{"doc_id":"d2","quote":""}')),
    _list("findings", _finding(), after='],"questions":[1]}'.removeprefix("]")), _list("findings", _finding(), after=',"other":1}'), "concat('{\"findings\":', cast(event_id AS varchar(20)), '}')", "concat('{\"findings\":[]}')",
    _list("findings", _finding(d="\\n"), _finding(q="A second")),
])

_ITEMS = "CASE WHEN strict AND json_type(bare, '$.{n}') = 'ARRAY' THEN json_extract(bare, '$.{n}[*]') END"
_TEXT_OK = "len(trim(coalesce(json_extract_string({f}, '$.{k}'), ''), chr(32) || chr(9) || chr(10) || chr(13))) > 0 AND json_type({f}, '$.{k}') = 'VARCHAR'"
_RELATED_OK = f"""(json_type({{f}}, '$.related_evidence') = 'NULL' OR json_type({{f}}, '$.related_evidence') = 'OBJECT' AND list_sort(json_keys({{f}}, '$.related_evidence')) = ['doc_id', 'quote']
  AND {_TEXT_OK.format(f="{f}", k="related_evidence.doc_id")} AND {_TEXT_OK.format(f="{f}", k="related_evidence.quote")})"""
_FINDING_OK = f"""coalesce(list_sort(json_keys(f)) = ['diagnosis', 'doc_id', 'quote', 'related_evidence', 'type'] AND {" AND ".join(_TEXT_OK.format(f="f", k=k) for k in ("doc_id", "quote", "type", "diagnosis"))}
  AND json_extract_string(f, '$.type') IN ('ambiguity', 'contradiction', 'gap') AND {_RELATED_OK.format(f="f")}, false)"""
_PLACE = r"json_extract_string(f, '$.doc_id') || chr(1) || array_to_string(regexp_extract_all(lower(json_extract_string(f, '$.quote')), '[\p{L}\p{N}]+'), ' ')"


def _all(items: str, ok: str, v: str = "f") -> str:
    return f"coalesce(list_bool_and(list_transform({items}, lambda {v}: {ok})), true)"


_FINDINGS_SQL = f"""{_strict_sql(_FINDINGS, _unique_keys("$"))},
y AS (SELECT *, {_ITEMS.replace("{n}", "findings")} AS items, CASE WHEN strict THEN list_sort(json_keys(bare)) END AS roots FROM x),
z AS (SELECT *, items IS NOT NULL AND {_all("items", _FINDING_OK)} AND len(list_distinct(list_transform(items, lambda f: {_PLACE}))) = len(items) AS ok FROM y)
SELECT event_id, CASE WHEN ok AND roots = ['findings'] THEN len(items) END::INTEGER AS alone, CASE WHEN ok AND roots IN (['findings'], ['findings', 'questions']) THEN len(items) END::INTEGER AS with_questions,
  CASE WHEN ok AND roots = ['findings'] THEN array_to_string(list_transform(items, lambda f: json_extract_string(f, '$.quote')), '|') END AS quotes FROM z"""


@_query(_FINDINGS_SQL)
@_raw
def finding_contract(spark, sf_dir):
    """Findings of an answer made for every event, in the two forms of the root, null where the form is broken."""
    e = _events(spark, sf_dir).withColumn("t", F.expr(_FINDINGS))
    read = e.select("event_id", J.findings_column(F.col("t")).alias("a"), J.findings_column(F.col("t"), 1).alias("b"))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return read.select("event_id", count("a").alias("alone"), count("b").alias("with_questions"), F.array_join(F.transform("a", lambda f: f["quote"]), "|").alias("quotes"))


_FRAME = '{"actor":"the board","action":" decides ","condition":"c","anchor_outcome":"o","alternative_outcome":"p"}'
_QUESTION = "'{\"doc_id\":\"d', cast(user_id AS varchar(20)), '\",\"quote\":\"a rule\",\"type\":\"{t}\",\"question\":\"{q}\",\"decision\":{d},\"yes_choice\":\"{y}\",\"related_evidence\":{r},\"target_stances\":{s}{x}}'"


def _question(t="gap", q="Should it hold?", d=_FRAME, y="anchor", r="null", s='{"f1":"agree","f2":"pass"}', x="") -> str:
    out = _QUESTION
    for k, v in (("t", t), ("q", q), ("d", d), ("y", y), ("r", r), ("s", s), ("x", x)):
        out = out.replace("{" + k + "}", v)
    return out


_LONG = _FRAME.replace('"c"', '"\', repeat(\'c\', 999 + cast(event_id % 2 AS int) * 2), \'"')
_QUESTIONS = _variants([
    _list("questions", _question()), _list("questions", _question(r=_REL), _question(t="ambiguity", y="alternative")), _list("questions", _question(q="Hold it?")), _list("questions", _question(q="Should it  hold?")),
    _list("questions", _question(q="Should it hold? Or not?")), _list("questions", _question(d=_FRAME.replace('"c"', '" "'))), _list("questions", _question(d=_FRAME.replace('"actor"', '"who"'))),
    _list("questions", _question(d=_LONG)), _list("questions", _question(y="yes")), _list("questions", _question(s="{}")), _list("questions", _question(s='{"f1":"maybe"}')), _list("questions", _question(s='{"":"agree"}')),
    _list("questions", _question(x=',"more":null')), _list("questions", _question(), after=',"findings":[]}'), _list("questions", _question(), after=',"findings":[1]}'), _list("questions", _question(s='{"f1":1}')), "concat('{\"questions\":{}}')",
])
_ASKS = "regexp_matches({q}, '^(" + "|".join(X.AUXILIARIES) + r") [^?]+\?$') AND NOT regexp_matches({q}, '[\t\n\f\r\x0B]|  | \?$')"
_FRAME_OK = "list_sort(json_keys(f, '$.decision')) = ['action', 'actor', 'alternative_outcome', 'anchor_outcome', 'condition'] AND " + " AND ".join(
    _TEXT_OK.format(f="f", k=f"decision.{k}") + f" AND len(json_extract_string(f, '$.decision.{k}')) <= {J.DECISION_CHARS}" for k in J.DECISION_FIELDS
)
_STANCES_OK = """json_type(f, '$.target_stances') = 'OBJECT' AND len(json_keys(f, '$.target_stances')) > 0 AND coalesce(list_bool_and(list_transform(json_keys(f, '$.target_stances'),
  lambda k: len(trim(k)) > 0 AND json_type(json_extract(f, '$.target_stances')->k) = 'VARCHAR' AND (json_extract(f, '$.target_stances')->>k) IN ('agree', 'disagree', 'pass'))), false)"""
_QUESTION_OK = f"""coalesce(list_sort(json_keys(f)) = ['decision', 'doc_id', 'question', 'quote', 'related_evidence', 'target_stances', 'type', 'yes_choice']
  AND {" AND ".join(_TEXT_OK.format(f="f", k=k) for k in ("doc_id", "quote", "type", "question", "yes_choice"))} AND {_ASKS.format(q="json_extract_string(f, '$.question')")}
  AND json_extract_string(f, '$.type') IN ('ambiguity', 'contradiction', 'gap') AND json_extract_string(f, '$.yes_choice') IN ('anchor', 'alternative') AND {_FRAME_OK} AND {_RELATED_OK.format(f="f")} AND {_STANCES_OK}, false)"""
_QUESTIONS_SQL = f"""{_strict_sql(_QUESTIONS, _unique_keys("$"))},
y AS (SELECT *, {_ITEMS.replace("{n}", "questions")} AS items, {_ITEMS.replace("{n}", "findings")} AS found, CASE WHEN strict THEN list_sort(json_keys(bare)) END AS roots FROM x),
z AS (SELECT *, items IS NOT NULL AND {_all("items", _QUESTION_OK)} AS ok, found IS NOT NULL AND {_all("found", _FINDING_OK)} AS found_ok FROM y)
SELECT event_id, CASE WHEN ok AND roots = ['questions'] THEN len(items) END::INTEGER AS alone, CASE WHEN ok AND (roots = ['questions'] OR roots = ['findings', 'questions'] AND found_ok) THEN len(items) END::INTEGER AS with_findings,
  CASE WHEN ok AND roots = ['questions'] THEN array_to_string(list_transform(items, lambda f: trim(json_extract_string(f, '$.decision.action')) || ':' || json_extract_string(f, '$.target_stances.f1')), '|') END AS said FROM z"""


@_query(_QUESTIONS_SQL)
@_raw
def question_contract(spark, sf_dir):
    """Questions of an answer made for every event, with and without findings beside them, null where the form is broken."""
    e = _events(spark, sf_dir).withColumn("t", F.expr(_QUESTIONS))
    read = e.select("event_id", J.questions_column(F.col("t")).alias("a"), J.questions_column(F.col("t"), True).alias("b"))
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    said = F.array_join(F.transform("a", lambda q: F.concat(q["decision"]["action"], F.lit(":"), q["target_stances"]["f1"])), "|")
    return read.select("event_id", count("a").alias("alone"), count("b").alias("with_findings"), said.alias("said"))


_PREDICTIONS = _variants([
    "'1'", "'-1'", "'0'", "'2'", "'true'", "'1.0'", "'0.5'", "'\"-1\"'", "'\" 1\"'", "'null'", "concat('{\"agree\":0.', cast(user_id % 10 AS varchar(5)), ',\"disagree\":0.5,\"pass\":0.4}')", "'{\"agree\":0.2,\"pass\":0.2}'",
    "'{\"1\":0.1,\"-1\":0.7,\"other\":9}'", "'{\"agree\":\"1\",\"pass\":true}'", "'{\"agree\":-1,\"disagree\":0,\"pass\":2}'", "'{\"agree\":0,\"disagree\":0,\"pass\":0}'", "'[1]'", "'{'", "'{\"agree\":1,\"disagree\":1,\"pass\":1,\"other\":0}'",
])
_NUMBER = "CASE WHEN json_type(j, '$.{k}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(j, '$.{k}')::DOUBLE END"
_SCORE = lambda a, b: f"coalesce({_NUMBER.replace('{k}', b)}, {_NUMBER.replace('{k}', a)})"
_LIKELIEST = "CASE WHEN a IS NOT NULL AND a >= coalesce(p, a) AND a >= coalesce(d, a) THEN 1 WHEN p IS NOT NULL AND p >= coalesce(d, p) THEN 0 WHEN d IS NOT NULL THEN -1 END"


@_query(f"""WITH e AS (SELECT event_id, {_PREDICTIONS} AS t FROM events), j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM e),
s AS (SELECT *, json_type(j) AS kind, {_SCORE("agree", '"1"')} AS a, {_SCORE("disagree", '"-1"')} AS d, {_SCORE("pass", '"0"')} AS p FROM j)
SELECT event_id, CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND j::DOUBLE IN (-1, 0, 1) THEN j::DOUBLE::INTEGER WHEN kind = 'VARCHAR' AND (j->>'$') IN ('-1', '0', '1') THEN (j->>'$')::INTEGER WHEN kind = 'OBJECT' THEN {_LIKELIEST} END AS lenient,
  CASE WHEN kind = 'OBJECT' AND list_sort(json_keys(j)) = ['agree', 'disagree', 'pass'] AND a >= 0 AND d >= 0 AND p >= 0 AND a + d + p > 0 THEN {_LIKELIEST} END AS strict FROM s""")
def vote_coercions(spark, sf_dir):
    """The vote that a prediction made for every event says: leniently, and as a distribution only."""
    return _events(spark, sf_dir).select("event_id", J.said_votes(F.expr(_PREDICTIONS)).alias("v")).select("event_id", "v.lenient", "v.strict")


_HELD = "concat('{\"', cast(user_id AS varchar(20)), ',1\":', cast(event_id % 4 - 1 AS varchar(5)), ',\"0,2\":', {x}, ',\"0,3\":0}')".replace("{x}", _variants(["'1'", "'1.0'", "'true'", "'\"1\"'", "'null'"]))


@_query(f"""WITH e AS (SELECT event_id, {_HELD}::JSON AS j FROM events), c AS (SELECT event_id, j, unnest(json_keys(j)) AS k FROM e),
v AS (SELECT event_id, k, json_extract(j, '$."' || k || '"') AS v FROM c)
SELECT event_id, count(*) FILTER (ok)::INTEGER AS n, coalesce(string_agg(k || '=' || (v::VARCHAR), ';' ORDER BY k) FILTER (ok), '') AS votes FROM (SELECT *, json_type(v) IN ('BIGINT', 'UBIGINT') AND v::VARCHAR IN ('-1', '0', '1') AS ok FROM v) GROUP BY event_id""")
def held_out_votes(spark, sf_dir):
    """The held-out votes of a JSON object made for every event; what is no vote is left out."""
    read = _events(spark, sf_dir).select("event_id", J.held_out_column(F.expr(_HELD)).alias("h"))
    pairs = F.array_sort(F.transform(F.map_entries("h"), lambda e: F.struct(e["key"].alias("k"), F.concat(e["key"], F.lit("="), e["value"].cast("string")).alias("t"))))
    return read.select("event_id", F.size("h").alias("n"), F.array_join(F.transform(pairs, lambda x: x["t"]), ";").alias("votes"))


_INFOS = _variants(["props", "concat('[', props, ']')", "concat(props, 'x')", "'3'", "'null'"])
_KEYS = _variants(["'{\"question_count\":3}'", "'{\"question_count\":0}'", "'{\"question_count\":true}'", "'{\"question_count\":2.0}'", "concat('{\"question_count\":', cast(user_id AS varchar(20)), '}')", "'{}'", "'[3]'"])


@_query(f"""WITH e AS (SELECT event_id, {_INFOS} AS i, {_KEYS}::JSON AS k FROM events), j AS (SELECT event_id, CASE WHEN json_valid(i) THEN i::JSON END AS i, k FROM e)
SELECT event_id, CASE WHEN json_type(i) = 'OBJECT' THEN json_extract(i, '$.k')::BIGINT END AS k,
  CASE WHEN json_type(k, '$.question_count') IN ('BIGINT', 'UBIGINT') AND json_extract(k, '$.question_count')::BIGINT > 0 THEN json_extract(k, '$.question_count')::BIGINT END AS question_count FROM j""")
def info_payloads(spark, sf_dir):
    """Infos that are objects or else empty, and the number of questions that answer keys ask for."""
    read = _events(spark, sf_dir).select("event_id", J.info_column(F.expr(_INFOS)).alias("i"), J.question_count_column(F.expr(_KEYS)).alias("question_count"))
    return read.select("event_id", F.get_json_object("i", "$.k").cast("long").alias("k"), "question_count")


_KEY = _variants([
    _list("findings", _finding(t="contradiction", r=_REL)), "concat('{\"findings\":[{\"doc_id\":', cast(user_id AS varchar(20)), ',\"anchor_quote\":\"a rule\",\"type\":\"gap\",\"canonical_question\":\"Is it?\",\"document_text\":\"All of a rule.\"}]}')",
    "'{\"findings\":[]}'", "'{}'", "'no key'",
])


@_query(f"""WITH e AS (SELECT event_id, {_KEY} AS t FROM events), j AS (SELECT event_id, unnest(CASE WHEN json_valid(t) THEN json_extract(t, '$.findings[*]') ELSE [] END) AS f FROM e)
SELECT event_id, json_extract_string(f, '$.doc_id') AS doc_id, coalesce(json_extract_string(f, '$.quote'), json_extract_string(f, '$.anchor_quote')) AS quote, json_extract_string(f, '$.type') AS type,
  coalesce(json_extract_string(f, '$.diagnosis'), json_extract_string(f, '$.canonical_question')) AS diagnosis, json_extract_string(f, '$.related_evidence.quote') AS related_quote,
  coalesce(json_extract_string(f, '$.document_text'), json_extract_string(f, '$.quote'), json_extract_string(f, '$.anchor_quote')) AS document FROM j""")
def planted_keys(spark, sf_dir):
    """Reference items of answer keys of either spelling."""
    rows = _events(spark, sf_dir).select("event_id", F.explode(J.planted_column(F.expr(_KEY))).alias("x"))
    return rows.select("event_id", "x.doc_id", "x.quote", "x.type", "x.diagnosis", F.col("x.related_evidence.quote").alias("related_quote"), F.col("x.document_text").alias("document"))
