"""Queries over retrieval and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import neighbours as nb
from quern.operators import retrieval as rt
from quern.operators import timeseries as ts
from quern.plans.registry import ORACLES, query
from quern.plans.relational import r6, t
from quern.plans.series import BASE, KEYS, filled
from quern.sources import indexes, vector_index
from quern.sources.retrievers import retriever
from quern.sources.shared import shared_path


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])), 5) AS score FROM n q JOIN n d ON true)
SELECT query_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s) WHERE rank <= 5""")
def dense_topk(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", rt.unit(F.col("embedding")).alias("v"))
    return rt.dense_topk(e.withColumnRenamed("vec_id", "doc_id"), e.withColumnRenamed("vec_id", "query_id"), 5, digits=5).select("query_id", "rank", "doc_id", "score")


@query(ORACLES["dense_topk"])
def ivf_topk(spark, d):
    """The same through a stored index of lists: exact, whatever lists it need not read."""
    path = shared_path(spark, "vectors")
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    vector_index.write_index(e, path, "IVF16,Flat")
    return vector_index.Index(spark, path).search(e.withColumnRenamed("doc_id", "query_id"), 5, digits=5)


_BM = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL),
z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(qtf * (ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl)))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), z GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s) WHERE rank <= {k}"""


def _bm25(spark, d, k):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rt.bm25_topk(t(spark, d, "documents").select("doc_id", "text"), q, k).select("query_id", "rank", "doc_id", "score")


@query(_BM.format(k=10))
def bm25_topk(spark, d):
    return _bm25(spark, d, 10)


@query(_BM.format(k=10))
def bm25_index_topk(spark, d):
    """The same through stored postings."""
    path = shared_path(spark, "postings")
    indexes.write_postings(t(spark, d, "documents").select("doc_id", "text"), path)
    return indexes.search_postings(spark, path, t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query("""SELECT query_id AS id, string_agg('Doc ' || rank || '(Title: ' || split_part(text, chr(10), 1) || ') ' || substr(text, length(split_part(text, chr(10), 1)) + 2) || chr(10), '' ORDER BY rank) AS information
  FROM (""" + _BM.format(k=3) + ") JOIN documents USING (doc_id) GROUP BY 1")
def retrieved_context(spark, d):
    path, docs = shared_path(spark, "postings"), t(spark, d, "documents")
    indexes.write_postings(docs.select("doc_id", "text"), path)
    find = retriever("bm25", path=path, corpus=docs.select("doc_id", F.col("text").alias("contents")), topk=3)
    return find(t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query")))


@query("SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id))::INTEGER AS rank, doc_id, (-n_chars)::DOUBLE AS score FROM (" + _BM.format(k=10) + ") JOIN documents USING (doc_id) QUALIFY rank <= 3".replace("QUALIFY rank", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id)"))
def rerank_topk(spark, d):
    c = _bm25(spark, d, 10).join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rt.rerank_topk(c, (-F.col("n_chars")).cast("double"), 3).select("query_id", "rank", "doc_id", "score")


_SIM = """WITH st AS (SELECT user_id, event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL), sp AS (SELECT event_type, max(value) - min(value) AS r FROM events GROUP BY 1),
p AS (SELECT a.user_id AS a, b.user_id AS b, round(avg(greatest(least(1 - (abs(a.m - b.m) + abs(a.s - b.s)) / (2 * r), 1.0), 0.0)), 6) AS similarity FROM st a JOIN st b ON a.event_type = b.event_type AND a.user_id < b.user_id JOIN sp ON sp.event_type = a.event_type GROUP BY ALL),
w AS (SELECT a, b, similarity FROM p UNION ALL SELECT b, a, similarity FROM p) """


@query(_SIM + "SELECT a, rank, b, similarity FROM (SELECT *, (row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b))::INTEGER AS rank FROM w) WHERE rank <= 5")
def stat_similarity_topk(spark, d):
    return nb.stat_neighbours(t(spark, d, "events"), "user_id", "event_type", "value", 5)[0]


@query(_SIM + "SELECT a % 2 = b % 2 AS same, round(avg(similarity), 6) AS mean FROM p GROUP BY 1")
def outcome_similarity(spark, d):
    return r6(nb.mean_similarity(t(spark, d, "events"), "user_id", "event_type", "value", F.col("entity") % 2), "mean")


def _shapes(spark, d):
    dense = ts.minmax(filled(spark, d), KEYS)
    v = F.transform(F.sort_array(F.collect_list(F.struct("hour", "value"))), lambda x: x["value"])
    return dense.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("item")).agg(v.alias("v")).withColumn("label", F.col("entity") % 2)


# A pair of series in 95 steps, one for each anti-diagonal of its 48 x 48 cells
_WARPED = BASE.replace("WITH e AS", "WITH RECURSIVE e AS", 1).rstrip() + """,
z AS (SELECT user_id, event_type, hour, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM f WINDOW w AS (PARTITION BY user_id, event_type)),
v AS (SELECT user_id, event_type, list(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END ORDER BY hour) AS v FROM z GROUP BY ALL HAVING max(CASE WHEN hi > lo THEN value - lo ELSE 0 END) > 0),
p AS (SELECT a.user_id AS a, b.user_id AS b, a.event_type AS item, a.v AS x, b.v AS y FROM v a JOIN v b ON a.event_type = b.event_type AND a.user_id < b.user_id WHERE a.event_type <> 'signup'),
d(a, b, item, x, y, n, older, old) USING KEY (a, b, item) AS (SELECT a, b, item, x, y, 0 AS n, list_transform(range(49), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE 'inf'::DOUBLE END) AS older, list_transform(range(49), lambda i: 'inf'::DOUBLE) AS old FROM p
  UNION SELECT a, b, item, x, y, n + 1, old, list_transform(range(49), lambda i: CASE WHEN i = 0 OR n - i + 1 NOT BETWEEN 0 AND 47 THEN 'inf'::DOUBLE ELSE (x[i] - y[n - i + 2]) ** 2 + least(old[i], old[i + 1], older[i]) END) FROM d WHERE n < 95),
w AS (SELECT a, b, item, sqrt(old[49]) AS d, CASE item WHEN 'view' THEN 2.0 ELSE 1.0 END AS w FROM d WHERE n = 95),
s AS (SELECT a, b, 1 / (1 + sum(d * w) / sum(w)) AS similarity FROM w GROUP BY ALL),
q AS (SELECT a, b, similarity FROM s UNION ALL SELECT b, a, similarity FROM s)
SELECT a, rank, b, round(similarity, 6) AS similarity FROM (SELECT *, (row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b))::INTEGER AS rank FROM q) WHERE rank <= 5"""


@query(_WARPED)
def dtw_topk(spark, d):
    return r6(nb.dtw_topk(_shapes(spark, d), 5, {"view": 2.0, "signup": 0.01}), "similarity")


@query("""SELECT conv_id, turn, list_extract(['T2', 'T1', 'T1'], (turn % 3 + 1)::INTEGER) AS first_title, list_extract([1, 2, 1], (turn % 3 + 1)::INTEGER)::BIGINT AS n FROM conversations""")
def doc_extract(spark, d):
    block = '<information>\nDoc 1(Title: "T1") alpha\nDoc 2(Title: "T2") beta\n</information>\n'
    said = F.array(F.lit(block + "<important_info>[2]</important_info>"), F.lit(block + block), F.lit(block + "<important_info>Doc1</important_info><information>Doc 1(Title: x) open"))
    docs = rt.documents_of(F.element_at(said, (F.col("turn") % 3 + 1).cast("int")))
    return t(spark, d, "conversations").select("conv_id", "turn", docs[0]["title"].alias("first_title"), F.size(docs).cast("long").alias("n"))
