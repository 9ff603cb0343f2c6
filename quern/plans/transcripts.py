"""Queries of parsers over one table of tagged texts, made from the turns of conversations; their SQL parses the same texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import prompts as pr
from quern.functions import text as tx
from quern.operators import agent as ag
from quern.operators import retrieval as rt
from quern.plans.registry import query
from quern.plans.relational import r6, t

SLOTS = 5
#: What a slot of a text may hold: {a} and {b} are words of the turn, {n} and {m} numbers that differ by turn and slot.
FORMS = (
    '<query>{"query": "{a}"}</query>', "<query> {a} </query>", '<query>{"query": ["{a}", "{b}"]}</query>', '<query>{"query": {n}}</query>', "<query>{a}", "<answer> {a} </answer>", "<answer>{a}<answer>{b}</answer>",
    "<search_complete> True </search_complete> {a}", "<search_complete>no</search_complete> {a} is unlikely to die", "<think>{a} <query>{b}</query></think>", "<important_info>[{n}], Doc 3, {m} 8</important_info>",
    '<information>\nDoc 1(Title: "{a}") {b}\nDoc {n}(Title: {b}) {a}\n</information>', "{a} #### {n},{m}.5 {b}", "{a} is likely to survive. CONFIDENCE: high", "HIGH risk {a}; confidence: Low {b} will die", "{a}", "low-risk {a} no\n{b} yes", "Finally answer {n}: {a}",
)


def _form(form: str, cut: str) -> str:
    """A form in slot j as SQL; cut: how the engine cuts an array from a place on."""
    parts = []
    for x in re.split(r"(\{[abnm]\})", form):
        if x in ("{a}", "{b}"):
            k = "ab".index(x[1])
            parts.append(cut.format(at=f"CAST((conv_id * 3 + turn * 5 + j * 7 + {k * 11}) % len(w) AS INT)", more=f"CAST((conv_id + j + {k}) % 4 AS INT)"))
        elif x in ("{n}", "{m}"):
            parts.append(f"CAST((conv_id * {31 if x == '{n}' else 13} + turn * 17 + j * 5) % {12 if x == '{n}' else 900} AS STRING)")
        elif x:
            parts.append("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(parts)


def _slot(cut: str) -> str:
    return f"CASE (conv_id * (j + 1) + turn * (j + 3) + j * j) % {len(FORMS)} " + " ".join(f"WHEN {k} THEN {_form(f, cut)}" for k, f in enumerate(FORMS)) + " END"


_MADE = _slot("array_to_string(w[{at} + 1 : {at} + 1 + {more}], ' ')")
SAID = f"WITH words AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), said AS (SELECT conv_id, turn, array_to_string(list_transform(range({SLOTS}), lambda j: {_MADE}), chr(10)) AS s FROM words) "


def said(spark, d) -> DataFrame:
    """conv_id, turn, s: several forms behind each other, closed and open, nested and repeated."""
    words = t(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    made = _slot("array_join(slice(w, {at} + 1, 1 + {more}), ' ')").replace("len(w)", "size(w)")
    return words.select("conv_id", "turn", F.expr(f"array_join(transform(sequence(0, {SLOTS - 1}), j -> {made}), chr(10))").alias("s"))


def text() -> Column:
    return F.col("s")


def bodies(tag: str) -> str:
    return f"regexp_extract_all(s, '(?s)<{tag}>(.*?)</{tag}>', 1)"


@query(SAID + f"SELECT conv_id, turn, trim({bodies('answer')}[-1]) AS last, CASE WHEN len({bodies('answer')}) >= 2 THEN trim({bodies('answer')}[-1]) END AS second FROM said")
def answer_extract(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.answer(text()).alias("last"), tx.answer(text(), 2).alias("second"))


@query(SAID + """, p AS (SELECT conv_id, turn, s, lower(trim(regexp_extract(s, '(?s)<search_complete>(.*?)</search_complete>', 1))) IN ('true', 'yes', '1', 'y') AS done,
  trim(regexp_extract(s, '(?s)<query>(.*?)</query>', 1)) AS body FROM said), j AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM p)
SELECT conv_id, turn, CASE WHEN done THEN 'done' WHEN regexp_matches(s, '(?s)<query>.*?</query>') THEN 'search' ELSE 'none' END AS action,
  CASE WHEN done THEN '' ELSE coalesce(CASE json_type(j, '$.query') WHEN 'VARCHAR' THEN j ->> '$.query' WHEN 'ARRAY' THEN j ->> '$.query[0]' END, body) END AS query FROM j""")
def action_parse(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.action(text()).alias("action"), tx.query_of(text()).alias("query"))


@query(SAID + """, i AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(s, '[0-9]+'), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND 8) AS l FROM said)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)::VARCHAR[], ',') AS ids FROM i""")
def important_ids(spark, d):
    return said(spark, d).select("conv_id", "turn", F.array_join(F.transform(tx.important_ids(text()), lambda x: x.cast("string")), ",").alias("ids"))


@query(SAID + f"""SELECT conv_id, turn, replace(replace(replace(replace(s, '<query>', ''), '</query>', ''), '<think>', ''), '</think>', '') AS plain, string_split(s, chr(10) || 'Doc ')[1] AS cut,
  regexp_replace(s, '(?s)<think>.*?</think>', '', 'g') AS less FROM said""")
def strip_and_cut(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.strip_tags(text(), "query", "think").alias("plain"), tx.cut_at(text(), "\nDoc ").alias("cut"), tx.without_section(text(), "<think>", "</think>").alias("less"))


def word(x: str) -> str:
    """A word by itself: letters and digits of all scripts are parts of words."""
    edge = r"[^\p{L}\p{Nd}_]"
    return f"(?:^|{edge}){x[2:-2]}(?:$|{edge})" if x.startswith(r"\b") else x


def says(patterns: tuple[str, ...]) -> str:
    return f"regexp_matches(e, '{'|'.join(map(word, patterns))}')"


@query(SAID + f""", b AS (SELECT *, CASE WHEN contains(s, '{tx.LOOP_START}') THEN string_split(s, '{tx.LOOP_START}')[2] ELSE s END AS b FROM said),
e AS (SELECT conv_id, turn, lower(CASE WHEN regexp_matches(b, '(?s)<search_complete>.*?</search_complete>') THEN regexp_extract(b, '(?s)<search_complete>.*?</search_complete>(.*)', 1)
  ELSE array_to_string(string_split(b, chr(10))[-10:], chr(10)) END) AS e FROM b),
o AS (SELECT conv_id, turn, CASE WHEN {says(tx.POSITIVE)} THEN 1 WHEN {says(tx.NEGATIVE)} THEN 0 ELSE -1 END AS legacy, {says(tx.SURVIVAL_FIRST)} AS lives FROM e)
SELECT conv_id, turn, legacy::INTEGER AS legacy, CASE WHEN lives THEN 0 ELSE legacy END::INTEGER AS fixed, CASE WHEN CASE WHEN lives THEN 0 ELSE legacy END = turn % 2 THEN 1.0 ELSE -0.5 END::DOUBLE AS reward FROM o""")
def outcome_parse(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.outcome(text(), legacy=True).alias("legacy"), tx.outcome(text()).alias("fixed"), tx.binary_reward(tx.outcome(text()), F.col("turn") % 2).alias("reward"))


def risky(w: str) -> str:
    return f"(contains(u, '{w} RISK') OR contains(u, '{w}-RISK') OR trim(u) = '{w}' OR starts_with(u, '{w}'))"


@query(SAID + f""", u AS (SELECT conv_id, turn, upper(s) AS u, regexp_extract(lower(s), 'confidence:[ \\t\\n\\r\\f]*(high|medium|low)', 1) AS c FROM said),
r AS (SELECT conv_id, turn, CASE WHEN {risky('HIGH')} THEN 1 WHEN {risky('LOW')} THEN 0 WHEN {' OR '.join(f"contains(u, '{x}')" for x in tx.DEATH_WORDS)} THEN 1 ELSE 0 END AS label,
  CASE WHEN {risky('HIGH')} THEN 0.9 WHEN {risky('LOW')} THEN 0.1 ELSE 0.5 END AS confidence, CASE c WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 END AS c FROM u)
SELECT conv_id, turn, label::INTEGER AS label, confidence::DOUBLE AS confidence, coalesce(CASE WHEN label = 1 THEN c ELSE 1 - c END, 0.5)::DOUBLE AS stated FROM r""")
def risk_parse(spark, d):
    r = tx.risk(text())
    return r6(said(spark, d).select("conv_id", "turn", r["label"].alias("label"), r["confidence"].alias("confidence"), tx.stated_confidence(text(), r["label"] == 1).alias("stated")), "stated")


@query(SAID + "SELECT conv_id, turn, replace(regexp_extract_all(s, '#### (-?[0-9.,]+)', 1)[1], ',', '') AS strict, regexp_extract_all(s, '-?[0-9][0-9.,]*')[-1] AS flexible FROM said")
def numeric_answer(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.gsm_strict(text()).alias("strict"), tx.last_number(text()).alias("flexible"))


@query(SAID + """SELECT conv_id, turn, strpos(s, '<query>') > 0 AND strpos(s, '</query>') > strpos(s, '<query>') AND strpos(s, '<answer>') > strpos(s, '</query>') AND strpos(s, '</answer>') > strpos(s, '<answer>') AS ok,
  regexp_matches(s, '(?i)finally answer|no more') AS stops FROM said""")
def tag_order(spark, d):
    return said(spark, d).select("conv_id", "turn", tx.tags_in_order(text(), "query", "answer").alias("ok"), tx.stops(text(), ["finally answer", "no more"]).alias("stops"))


@query(SAID + f""", b AS (SELECT conv_id, turn, list_filter(list_transform({bodies('query')}, lambda x: trim(x)), lambda x: x <> '' AND x <> 'your query') AS q,
  trim(regexp_extract(CASE WHEN contains(s, '</query>') THEN s ELSE s || '</query>' END, '(?s)<query>(.*?)</query>', 1)) AS cut FROM said) SELECT conv_id, turn, q[-1] AS last, cut FROM b""")
def transcript_bits(spark, d):
    return said(spark, d).select("conv_id", "turn", pr.last_body(text(), "query", ["your query"]).alias("last"), pr.auto_closed(text(), "query").alias("cut"))


_WS = r"[\t-\r ]"


@query(SAID + f"""SELECT conv_id, turn, array_to_string(flatten(list_transform({bodies('information')}, lambda x: regexp_extract_all(x, 'Doc{_WS}+[0-9]+\\(Title:{_WS}*([^\\n]*?)\\)', 1))), ',') AS titles,
  array_to_string(flatten(list_transform({bodies('information')}, lambda x: regexp_extract_all(x, 'Doc{_WS}+[0-9]+\\(Title:{_WS}*[^\\n]*?\\){_WS}*([^\\n]*)', 1))), '|') AS texts FROM said""")
def plain_extract(spark, d):
    return said(spark, d).select("conv_id", "turn", F.array_join(tx.plain_titles(text()), ",").alias("titles"), F.array_join(tx.plain_texts(text()), "|").alias("texts"))


_HEAD = r'^([0-9]+) ?\(Title: ?"?([^\n]*?)"?\)'


def ids_in(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[0-9]+'), lambda y: try_cast(y AS INTEGER)), lambda y: y BETWEEN 1 AND 8)"


@query(SAID + f""", b AS (SELECT conv_id, turn, list_filter(string_split(s, '<information>')[2:], lambda x: contains(x, '</information>')) AS segments FROM said),
p AS (SELECT conv_id, turn, k, string_split(regexp_replace(string_split(segment, '</information>')[1], 'Doc ([0-9]+ ?\\(Title:)', chr(1) || '\\1', 'g'), chr(1))[2:] AS pieces,
  regexp_extract_all(string_split(segment, '</information>')[-1], '(?s)<important_info>(.*?)</important_info>', 1)[1] AS picked FROM (SELECT conv_id, turn, unnest(segments) AS segment, generate_subscripts(segments, 1) AS k FROM b)),
d AS (SELECT *, regexp_extract(piece, '{_HEAD}', 1)::INTEGER AS number, regexp_extract(piece, '{_HEAD}', 2) AS title, trim(regexp_replace(piece, '{_HEAD}', ''), ' ' || chr(10)) AS body
  FROM (SELECT conv_id, turn, k, picked, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM p) WHERE regexp_matches(piece, '{_HEAD}')),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY picked IS NULL, k, j) AS place FROM d WHERE picked IS NULL OR list_contains({ids_in('picked')}, number)),
f AS (SELECT conv_id, turn, body, min(place) AS place, arg_min(title, place) AS title FROM c GROUP BY conv_id, turn, body)
SELECT conv_id, turn, coalesce(n, 0)::BIGINT AS n, coalesce(titles, '') AS titles, coalesce(texts, '') AS texts FROM said
  LEFT JOIN (SELECT conv_id, turn, count(*) AS n, string_agg(title, '|' ORDER BY place) AS titles, string_agg(body, '|' ORDER BY place) AS texts FROM f GROUP BY ALL) USING (conv_id, turn)""")
def transcript_documents(spark, d):
    told = said(spark, d).select("conv_id", "turn", rt.documents_of(text()).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda y: y[c]), "|")
    return told.select("conv_id", "turn", F.size("x").cast("long").alias("n"), joined("title").alias("titles"), joined("text").alias("texts"))


@query(SAID + f""", z AS (SELECT conv_id, turn, {bodies('query')} AS q, {bodies('information')} AS r, {bodies('important_info')} AS i FROM said)
SELECT conv_id, turn, step::INTEGER AS step, q[step] AS query, r[step] AS result, i[step] AS important FROM (SELECT *, unnest(range(1, greatest(len(q), len(r), len(i)) + 1)) AS step FROM z)""")
def transcript_steps(spark, d):
    return ag.triples(said(spark, d), "s").select("conv_id", "turn", "step", "query", "result", "important")
