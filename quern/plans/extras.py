"""Queries over batches as tables and rendered texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import prompts as pr
from quern.operators import batch as bt
from quern.operators import timeseries as ts
from quern.plans.batches import E, steps
from quern.plans.registry import query
from quern.plans.relational import r6, t


@query("SELECT c_custkey, c_nationkey, c_name, c_acctbal FROM customer")
def merge_columns(spark, d):
    c = t(spark, d, "customer")
    return bt.merged(c.select("c_custkey", "c_nationkey", "c_name"), c.select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey").select("c_custkey", "c_nationkey", "c_name", "c_acctbal")


@query("SELECT item_id, i::INTEGER AS copy FROM (SELECT item_id, unnest([0, 1, 2]) AS i FROM benchmark)")
def repeat_rows(spark, d):
    return bt.repeated(t(spark, d, "benchmark").select("item_id"), 3)


@query("SELECT item_id, (ntile(4) OVER (ORDER BY item_id) - 1)::INTEGER AS chunk FROM benchmark")
def split_chunks(spark, d):
    return bt.chunks(t(spark, d, "benchmark").select("item_id"), "item_id", 4)


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, role FROM conversations")
def fold_unfold(spark, d):
    return bt.unfolded(bt.folded(t(spark, d, "conversations"), ["conv_id"], "turn", "role"), "role")


@query("SELECT q AS g, i::INTEGER AS item, CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END AS cluster FROM (SELECT DISTINCT item_id AS q FROM benchmark), (SELECT unnest(range(4)) AS i)")
def greedy_clusters(spark, d):
    same = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 2), (1, 3))])
    return bt.greedy_clusters(t(spark, d, "benchmark").select(F.col("item_id").alias("g"), F.lit(4).alias("n"), same.alias("same")), "g", "n")


@query("""WITH RECURSIVE t AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text) AS n FROM conversations),
r AS (SELECT g, i, [i] AS picks, [n] AS sizes FROM t WHERE i = 1
  UNION ALL SELECT t.g, t.i, CASE WHEN list_bool_or(list_transform(sizes, lambda x: abs(x - t.n) <= 60)) THEN picks ELSE list_append(picks, t.i) END,
    CASE WHEN list_bool_or(list_transform(sizes, lambda x: abs(x - t.n) <= 60)) THEN sizes ELSE list_append(sizes, t.n) END FROM r JOIN t ON t.g = r.g AND t.i = r.i + 1),
f AS (SELECT g, arg_max(picks, i) AS picks, arg_max(sizes, i) AS sizes FROM r GROUP BY 1)
SELECT t.g, t.turn AS item, (CASE WHEN list_contains(picks, t.i) THEN list_position(picks, t.i) ELSE list_max(list_filter(range(1, len(picks) + 1), lambda k: picks[k] < t.i AND abs(sizes[k] - t.n) <= 60)) END - 1)::INTEGER AS cluster FROM t JOIN f USING (g)""")
def answer_groups(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("item"), F.length("text").alias("n"))
    a, b = c.select("g", F.col("item").alias("a"), F.col("n").alias("na")), c.select("g", F.col("item").alias("b"), F.col("n").alias("nb"))
    same = a.join(b, "g").filter("a < b AND abs(na - nb) <= 60").select("g", "a", "b")
    return bt.greedy_groups(c, same, "g", "item")


@query(E + ", l AS (SELECT user_id, max(pos) AS last FROM e WHERE mask = 1 GROUP BY 1) SELECT event_id, round(CASE WHEN pos = last THEN r ELSE 0.0 END, 6) AS reward FROM e LEFT JOIN l USING (user_id)")
def last_token_reward(spark, d):
    return r6(bt.last_token_reward(steps(spark, d), ["user_id"], "pos", "mask", "r").select("event_id", "reward"), "reward")


@query("""WITH c AS (SELECT user_id, event_type, round(value) AS v, count(*) AS k FROM events WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT user_id, event_type, sum(k)::BIGINT AS n, min(v) AS lo, max(v) AS hi, round(sum(v * k) / sum(k), 6) AS mean, arg_min(v, (-k, v)) AS mode FROM c GROUP BY user_id, event_type)
SELECT user_id, event_type, n, lo AS min, hi AS max, mean, mode, event_type = 'view' AND lo < 10 AS low, (event_type = 'view' AND hi > 90) OR (event_type = 'click' AND hi > 95) AS high FROM g""")
def indicator_summary(spark, d):
    e = t(spark, d, "events").withColumn("v", F.round("value"))
    return r6(ts.indicator_summary(e, ["user_id", "event_type"], "v", {"view": (10.0, 90.0), "click": (None, 95.0)}, "event_type"), "mean")


@query("""WITH v AS (SELECT vec_id, [list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE) for i in range(8)] AS v FROM embeddings),
m AS (SELECT vec_id, v, list_filter(v, lambda x, i: i <= 1 + vec_id % 8) AS k FROM v)
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda j: j * list_sum(list_transform(k, lambda x: x[j])) / len(k))), 6) AS mean, round(list_sum(v[1]), 6) AS cls FROM m""")
def pooled_tokens(spark, d):
    e = t(spark, d, "embeddings")
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    told = e.select("vec_id", v.alias("v"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int")).alias("mask"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    mean = pr.pooled(F.col("v"), F.col("mask"), pr.POOLING["e5"])
    return r6(told.select("vec_id", total(F.transform(mean, lambda x, j: x * (j + 1))).alias("mean"), total(pr.pooled(F.col("v"), F.col("mask"), pr.POOLING["bge"])).alias("cls")), "mean", "cls")


@query("""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(ids[-8:]::VARCHAR[], ',') AS "left", array_to_string(ids[1:8]::VARCHAR[], ',') AS "right", array_to_string(CASE WHEN len(ids) <= 8 THEN ids ELSE list_concat(ids[1:4], ids[-4:]) END::VARCHAR[], ',') AS middle FROM w""")
def truncation_modes(spark, d):
    told = t(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda x: F.length(x).cast("long")).alias("ids"))
    said = lambda how: F.array_join(F.transform(pr.truncated(F.col("ids"), 8, how), lambda x: x.cast("string")), ",").alias(how)
    return told.select("conv_id", "turn", *map(said, ("left", "right", "middle")))


@query("""WITH l AS (SELECT conv_id, turn, split_part(text, chr(10), 1) AS title, text FROM conversations)
SELECT conv_id, string_agg('Doc ' || (turn + 1) || '(Title: ' || title || ') ' || substr(text, length(title) + 2) || chr(10), '' ORDER BY turn) AS context FROM l GROUP BY 1""")
def passages_text(spark, d):
    docs = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t(spark, d, "conversations").groupBy("conv_id").agg(pr.passages(docs).alias("context"))


@query("SELECT count(*) AS position FROM documents WHERE doc_id < (SELECT min(doc_id) FROM documents WHERE contains(text, 'License'))")
def progress_position(spark, d):
    return bt.first_containing(t(spark, d, "documents"), "doc_id", "text", "License")


@query("SELECT round((6.0 * 1000 * sum(n_chars) + 12 * 2 * 8 * sum(n_chars * n_chars::DOUBLE)) / 1e6, 3) AS mflops FROM documents")
def flops_estimate(spark, d):
    return bt.flops(t(spark, d, "documents"), "n_chars", 2, 8, 1000).select(F.round(F.col("flops") / 1e6, 3).alias("mflops"))


@query("SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Size: ' || p_size AS record, 'user' AS role, 'query: ' || p_brand AS e5 FROM part")
def render_record(spark, d):
    text = pr.record({"Name": F.col("p_name"), "Gone": F.lit(None).cast("string"), "Size": F.col("p_size")})
    return t(spark, d, "part").select("p_partkey", text.alias("record"), pr.chat(text)[0]["role"].alias("role"), pr.encoder_text(F.col("p_brand"), "e5", True).alias("e5"))


@query("SELECT o_orderkey, left(CASE WHEN o_totalprice > 100000 THEN 'high price ' ELSE '' END || o_orderpriority, 12) AS query FROM orders")
def query_rewrite(spark, d):
    return t(spark, d, "orders").select("o_orderkey", pr.rewritten([F.when(F.col("o_totalprice") > 100000, "high price"), F.col("o_orderpriority")], 12).alias("query"))


@query(E + "SELECT event_id, round(CASE WHEN pos = max(pos) OVER (PARTITION BY user_id) THEN r ELSE 0 END - 0.1 * (r - v), 6) AS reward FROM e")
def kl_reward(spark, d):
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("user_id"))
    return r6(steps(spark, d).select("event_id", pr.kl_reward(F.col("r"), F.col("r") - F.col("v"), 0.1, last).alias("reward")), "reward")


@query("SELECT q.item_id AS query_id, d.doc_id FROM benchmark q JOIN documents d ON d.doc_id % 50 = q.item_id % 50")
def candidate_pairs(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 50).alias("b"))
    return t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("b")).join(q, "b").select("query_id", "doc_id")


@query("SELECT o_orderkey, array_to_string(list_concat(list_filter(a, lambda x: x = 0), list_filter(a, lambda x: x <> 0))::VARCHAR[], ',') AS ids, len(list_filter(a, lambda x: x <> 0)) - 2 AS shown FROM (SELECT o_orderkey, o_custkey, [0, o_custkey % 3, 5, 0, 6, 7] AS a FROM orders)")
def info_masked_concat(spark, d):
    arr = lambda *x: F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v for v in x])
    prompt = arr(0, F.col("o_custkey") % 3)
    both = bt.masked_concat(prompt, prompt, arr(5, 0), arr(6, 7), 0)
    shown = F.size(F.filter(both["masked"], lambda x: x != 0))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(both["ids"], lambda v: v.cast("string")), ",").alias("ids"), shown.cast("long").alias("shown"))


@query("WITH m AS (SELECT max(l_linenumber) AS m FROM lineitem WHERE l_linenumber <= 3) SELECT o_orderkey, array_to_string(list_concat([0], [o_orderkey % 7, 1, 2][-m:])[-m:]::VARCHAR[], ',') AS ids FROM orders, m")
def effective_length(spark, d):
    n = F.lit(3)
    ids = F.array(F.lit(0).cast("long"), F.col("o_orderkey") % 7, F.lit(1).cast("long"), F.lit(2).cast("long"))
    mask = F.transform(ids, lambda _, i: F.when(i >= 4 - n, 1).otherwise(0).cast("long"))
    out = bt.cut_to_effective(t(spark, d, "orders").select("o_orderkey", ids.alias("ids"), mask.alias("mask")), "ids", "mask")
    return out.select("o_orderkey", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


@query("SELECT section, timing_s::DOUBLE AS timing_s, round(timing_s * 1000 / CASE section WHEN 'gen' THEN r ELSE p + r END, 9) AS ms_per_token FROM (SELECT sum(n_chars) AS p, sum(doc_id) AS r FROM documents), (VALUES ('gen', 2.5), ('ref', 1.5)) AS v(section, timing_s)")
def timing_per_token(spark, d):
    out = bt.timing_per_token(t(spark, d, "documents"), "n_chars", "doc_id", {"gen": 2.5, "ref": 1.5})
    return out.withColumn("ms_per_token", F.round("ms_per_token", 9))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(least(x::DOUBLE / 2, 0.05), -0.04))), 6) AS total FROM embeddings")
def tempered_clamp(spark, d):
    from quern.operators import rl

    x = F.transform("embedding", lambda v: v.cast("double"))
    same = lambda c: F.transform(x, lambda _: F.lit(c))
    out = F.aggregate(rl.clamped(rl.tempered(x, 2.0), same(-0.04), same(0.05)), F.lit(0.0), lambda s, v: s + v)
    return t(spark, d, "embeddings").select("vec_id", F.round(out, 6).alias("total"))
