"""Queries over batches: policy-optimisation math, sampling, trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import agent as ag
from quern.operators import rl
from quern.operators import sampling as sm
from quern.plans.registry import query
from quern.plans.relational import r6, t

E = """WITH e AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS pos, value / 100 AS r, (value % 7) / 10 AS v, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS mask, event_type FROM events WHERE value IS NOT NULL) """


def steps(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    e = t(spark, d, "events").filter("value IS NOT NULL")
    return e.select("user_id", "event_id", pos.alias("pos"), (F.col("value") / 100).alias("r"), (F.col("value") % 7 / 10).alias("v"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).alias("mask"), "event_type")


@query(E + """, s AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER w, 0) - v AS delta, max(pos) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT a.user_id, a.pos, round(sum(pow(0.99 * 0.5, b.pos - a.pos) * b.delta), 4) AS advantage FROM s a JOIN s b ON a.user_id = b.user_id AND b.pos >= a.pos GROUP BY ALL""")
def gae(spark, d):
    out = rl.gae(steps(spark, d), ["user_id"], "pos", "r", "v", 0.99, 0.5)
    return out.select("user_id", "pos", F.round("advantage", 4).alias("advantage"))


@query(E + "SELECT event_id, round((r - avg(r) FILTER (mask = 1) OVER ()) / sqrt(var_samp(r) FILTER (mask = 1) OVER () + 1e-8), 5) AS white FROM e")
def masked_whiten(spark, d):
    return rl.whiten(steps(spark, d), "r", "mask", "white").select("event_id", F.round("white", 5).alias("white"))


@query(E + "SELECT round(sum(r), 6) AS sum, round(avg(r), 6) AS mean, round(var_samp(r), 6) AS var FROM e WHERE mask = 1")
def masked_stats(spark, d):
    return r6(rl.masked_stats(steps(spark, d), "r", "mask"), "sum", "mean", "var")


@query(E + ", g AS (SELECT *, CASE WHEN event_id < 5 THEN -event_id ELSE user_id END AS uid FROM e) SELECT event_id, round(CASE WHEN count(*) OVER w = 1 THEN r / (1 + 1e-6) ELSE (r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-6) END, 5) AS advantage FROM g WINDOW w AS (PARTITION BY uid)")
def group_norm(spark, d):
    told = steps(spark, d).withColumn("uid", F.when(F.col("event_id") < 5, -F.col("event_id")).otherwise(F.col("user_id")))
    return rl.group_norm(told, "uid", "r").select("event_id", F.round("advantage", 5).alias("advantage"))


@query(E + "SELECT event_id, round(r - v, 6) AS kl, round(abs(r - v), 6) AS abs, round(0.5 * (r - v) * (r - v), 6) AS mse, round(greatest(least(exp(v - r) + r - v - 1, 10.0), -10.0), 6) AS low_var FROM e")
def kl_estimators(spark, d):
    k = lambda kind: F.round(rl.kl(F.col("r"), F.col("v"), kind), 6)
    return steps(spark, d).select("event_id", k("kl").alias("kl"), k("abs").alias("abs"), k("mse").alias("mse"), k("low_var_kl").alias("low_var"))


@query(E + ", s AS (SELECT -(r - 0.5) * exp(v - r) AS a, -(r - 0.5) * greatest(least(exp(v - r), 1.2), 0.8) AS b, r - v AS k FROM e WHERE mask = 1) SELECT round(avg(greatest(a, b)), 6) AS loss, round(avg((b > a)::INT), 6) AS clipfrac, round(avg(k), 6) AS approx_kl FROM s")
def ppo_loss(spark, d):
    return r6(rl.ppo_loss(steps(spark, d).withColumn("adv", F.col("r") - 0.5), "mask", "r", "v", "adv"), "loss", "clipfrac", "approx_kl")


@query(E + ", s AS (SELECT pow(v - 0.3, 2) AS a, pow(greatest(least(v, r + 0.5), r - 0.5) - 0.3, 2) AS b FROM e WHERE mask = 1) SELECT round(0.5 * avg(greatest(a, b)), 6) AS value_loss, round(avg((b > a)::INT), 6) AS value_clipfrac FROM s")
def value_loss(spark, d):
    return r6(rl.value_loss(steps(spark, d).withColumn("ret", F.lit(0.3)), "mask", "v", "r", "ret"), "value_loss", "value_clipfrac")


@query(E + "SELECT event_id, ((sum(mask) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1) * mask)::BIGINT AS position FROM e")
def position_ids(spark, d):
    return rl.position_ids(steps(spark, d), ["user_id"], "pos", "mask").select("event_id", F.col("position").cast("long").alias("position"))


@query(E + "SELECT event_id, CASE WHEN coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS eos_mask FROM e")
def eos_mask(spark, d):
    return rl.eos_mask(steps(spark, d), ["user_id"], "pos", F.col("event_type") == "purchase").select("event_id", "eos_mask")


@query("SELECT o_orderkey, array_to_string(list_concat(list_filter(a, lambda x: x = 0), list_filter(a, lambda x: x <> 0))::VARCHAR[], ',') AS ids, array_to_string(list_concat(a[1:2], [0])::VARCHAR[], ',') AS cut FROM (SELECT o_orderkey, [o_custkey % 3, o_orderkey % 2, 1, 0] AS a FROM orders) WHERE len(a[1:2]) = 2")
def pad_partition(spark, d):
    a = F.array((F.col("o_custkey") % 3), F.col("o_orderkey") % 2, F.lit(1).cast("long"), F.lit(0).cast("long"))
    said = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return t(spark, d, "orders").select("o_orderkey", said(rl.pads_left(a, 0)).alias("ids"), said(rl.fixed_length(F.slice(a, 1, 2), 3, 0)).alias("cut"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), z AS (SELECT vec_id, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM x)
SELECT vec_id, round(z - list_sum(list_transform(v, lambda x: exp(x - z) * x)), 6) AS entropy, round(v[1 + vec_id % 64] - z, 6) AS logprob FROM z""")
def softmax_entropy(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = t(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return r6(e.select("vec_id", rl.entropy(F.col("v")).alias("entropy"), rl.chosen_logprob(F.col("v"), (1 + F.col("vec_id") % 64).cast("int")).alias("logprob")), "entropy", "logprob")


B = "('0x' || substr(md5({}::VARCHAR || '|42'), 1, 8))::BIGINT"


@query(f"SELECT event_id, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split FROM (SELECT event_id, {B.format('user_id')} % 100 AS b FROM events)")
def hash_split(spark, d):
    return sm.hash_split(t(spark, d, "events"), "user_id", {"train": 90, "val": 5, "test": 5}).select("event_id", "split")


R = "SELECT *, row_number() OVER (PARTITION BY {} ORDER BY md5({}::VARCHAR || '|42'), {}) AS r, count(*) OVER (PARTITION BY {}) AS n FROM {}"


@query("SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM (" + R.format("quality", "doc_id", "doc_id", "quality", "labels") + ")")
def stratified_split(spark, d):
    return sm.stratified_split(t(spark, d, "labels"), "quality", "doc_id", [("train", 0.8), ("val", 0.1), ("test", 0.1)]).select("doc_id", "quality", "split")


@query("SELECT doc_id, quality FROM (" + R.format("quality", "doc_id", "doc_id", "quality", "labels") + ") WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))")
def undersample(spark, d):
    return sm.undersample(t(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, source FROM (" + R.format("source", "doc_id", "doc_id", "source", "documents") + ") WHERE r <= 30")
def cap_per_source(spark, d):
    return sm.cap_per_source(t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 30)


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT 100")
def uniform_sample(spark, d):
    return sm.uniform_sample(t(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)")
def positional_split(spark, d):
    return sm.positional_split(t(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"SELECT doc_id FROM labels WHERE NOT (quality = 1 AND {B.format('doc_id')} % 2 = 0)")
def drop_half_correct(spark, d):
    return sm.drop_half(t(spark, d, "labels"), "doc_id", F.col("quality") == 1).select("doc_id")


@query("""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, n_chars AS n FROM documents), g(key, i, loads) USING KEY (key) AS (
  SELECT 1 AS key, 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS loads
  UNION SELECT key, o.i, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + o.n ELSE x END) FROM g JOIN o ON o.i = g.i + 1)
SELECT (part - 1)::INTEGER AS part, loads[part] AS total FROM g, (SELECT unnest([1, 2, 3, 4]) AS part)""")
def greedy_partition(spark, d):
    return sm.greedy_partition(t(spark, d, "documents"), "n_chars", 4)


@query()
def karmarkar_karp(spark, d):
    return sm.balanced_partition(t(spark, d, "documents"), "source", "doc_id", "n_chars", 4)


def _spread(parts):
    """Of a table (source, n_chars, part, parts): what balanced parts have to hold."""
    sums = parts.groupBy("source", "part").agg(F.max("parts").alias("parts"), F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("longest"))
    even = F.max("s") - F.min("s") <= 2 * F.max("longest")
    return sums.groupBy("source").agg(F.max("parts").alias("parts"), F.sum("n").alias("rows"), F.sum("s").alias("tokens"), (F.count("*") == F.max("parts")).alias("full"), even.alias("even"))


_SPREAD = "SELECT source, {} AS parts, count(*) AS rows, sum(n_chars)::BIGINT AS tokens, true AS full, true AS even FROM documents GROUP BY 1"


@query(_SPREAD.format("greatest(ceil(sum(n_chars) / 8192), 1)::BIGINT"))
def micro_batches(spark, d):
    docs = t(spark, d, "documents")
    return _spread(sm.micro_batches(docs, "source", "doc_id", "n_chars", 8192).join(docs.select("doc_id", "n_chars"), "doc_id"))


@query(_SPREAD.format("4::BIGINT"))
def partition_spread(spark, d):
    docs = t(spark, d, "documents")
    return _spread(sm.balanced_partition(docs, "source", "doc_id", "n_chars", 4, room=64).withColumn("parts", F.lit(4).cast("long")).join(docs.select("doc_id", "n_chars"), "doc_id"))


@query("SELECT doc_id, b::BIGINT AS batch FROM (SELECT doc_id, (r - 1) // 64 AS b, n FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents)) WHERE (b + 1) * 64 <= n")
def model_batches(spark, d):
    return sm.model_batches(t(spark, d, "documents").select("doc_id"), "doc_id", 64)


@query("""SELECT round(avg(turns), 6) AS turns, round(avg(valid), 6) AS valid, round(avg(searches), 6) AS searches, round(avg(finished), 6) AS finished FROM (SELECT conv_id, count(*) AS turns, sum((role = 'user')::INT) AS valid, sum((length(text) > 100)::INT) AS searches, max((role = 'assistant')::INT) AS finished FROM conversations GROUP BY 1)""")
def traj_stats(spark, d):
    return r6(ag.trajectory_stats(t(spark, d, "conversations"), "conv_id", F.col("role") == "user", F.length("text") > 100, F.col("role") == "assistant"), "turns", "valid", "searches", "finished")


@query("SELECT conv_id, turn, i::INTEGER AS step, 'q' || i AS query, role AS result, i::VARCHAR AS important FROM (SELECT conv_id, turn, role, unnest([1, 2]) AS i FROM conversations)")
def history_triples(spark, d):
    one = lambda i: F.concat(F.lit(f"<query>q{i}</query><information>"), "role", F.lit(f"</information><important_info>{i}</important_info>"))
    c = t(spark, d, "conversations").withColumn("history", F.concat(one(1), one(2)))
    return ag.triples(c, "history").select("conv_id", "turn", "step", "query", "result", "important")
