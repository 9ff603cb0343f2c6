"""Queries over scores. Labels are those of documents; a score is a function of the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import scoring as sc
from quern.plans.registry import query
from quern.plans.relational import r6, t

L = "WITH l AS (SELECT doc_id, source, quality, (doc_id * 7 % 50) / 50.0::DOUBLE AS score, n_chars::DOUBLE AS len, CASE WHEN doc_id * 7 % 50 >= 20 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id)) "


def labelled(spark, d):
    both = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels"), "doc_id")
    h = F.col("doc_id") * 7 % 50
    return both.select("doc_id", "source", "quality", (h / 50).alias("score"), F.col("n_chars").cast("double").alias("len"), F.when(h >= 20, 1).otherwise(0).alias("guess"))


@query(L + """, c AS (SELECT count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality <> 1 AND guess = 1) AS fp, count(*) FILTER (quality = 1 AND guess <> 1) AS fn, count(*) FILTER (quality <> 1 AND guess <> 1) AS tn FROM l)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_prf(spark, d):
    return r6(sc.confusion(labelled(spark, d), "quality", "guess"), "accuracy", "precision", "recall", "f1")


@query(L + """, s AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM l GROUP BY 1)
SELECT round(sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS auroc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)""")
def auroc(spark, d):
    return r6(sc.auroc(labelled(spark, d), "quality", "score"), "auroc")


@query(L + """, s AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM l GROUP BY 1)
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS auprc FROM (SELECT *, (sum(p) OVER w)::DOUBLE AS tp, (sum(n) OVER w)::DOUBLE AS fp FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""")
def auprc(spark, d):
    return r6(sc.average_precision(labelled(spark, d), "quality", "score"), "auprc")


@query(L + "SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN quality = 1 AND guess = 1 THEN 1.0 ELSE 0.0 END), 6) AS em FROM l GROUP BY ROLLUP (source)")
def rollup_accuracy(spark, d):
    return r6(sc.rollup_accuracy(labelled(spark, d), "source", F.col("quality") == F.col("guess"), (F.col("quality") == 1) & (F.col("guess") == 1)), "accuracy", "em")


@query(L + """SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, sum(len) AS total, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6) AS p50,
  round(quantile_cont(len, 0.9), 6) AS p90, round(quantile_cont(len, 0.95), 6) AS p95, round(quantile_cont(len, 0.99), 6) AS p99 FROM l GROUP BY ROLLUP (source)""")
def length_percentiles(spark, d):
    return r6(sc.length_stats(labelled(spark, d), "source", F.col("len")), "mean", "p50", "p90", "p95", "p99")


@query(L + "SELECT round(avg((score = 0)::INT), 6) AS eq_0, round(avg((score = 0.5)::INT), 6) AS eq_0_5, round(avg((score >= 0.2)::INT), 6) AS ge_0_2, round(avg((score >= 0.9)::INT), 6) AS ge_0_9 FROM l")
def reward_hist(spark, d):
    return r6(sc.histogram(labelled(spark, d), "score", [0, 0.5], [0.2, 0.9]), "eq_0", "eq_0_5", "ge_0_2", "ge_0_9")


@query(L + "SELECT round(avg((m = 1)::INT), 6) AS pass_at_k, count(*) AS questions FROM (SELECT doc_id % 100 AS q, max(quality) AS m FROM l GROUP BY 1)")
def pass_at_k(spark, d):
    return r6(sc.pass_at_k(labelled(spark, d).withColumn("q", F.col("doc_id") % 100), "q", "quality"), "pass_at_k")


@query(L + """, m AS (SELECT source, avg(score) AS score, avg(quality) AS quality, avg(len) AS len FROM l GROUP BY 1), u AS (UNPIVOT m ON score, quality, len INTO NAME metric VALUE value)
SELECT metric, arg_max(source, (value, source)) AS model, round(max(value), 6) AS value FROM u GROUP BY 1""")
def argmax_metric(spark, d):
    means = labelled(spark, d).groupBy("source").agg(F.avg("score").alias("score"), F.avg("quality").alias("quality"), F.avg("len").alias("len"))
    return r6(sc.best_per_metric(means, "source", ["score", "quality", "len"]), "value")


_CL = L + ", g AS (SELECT doc_id % 40 AS q, doc_id % 3 AS c, -score * 10 AS ll FROM l)"


def clustered(spark, d):
    return labelled(spark, d).select((F.col("doc_id") % 40).alias("q"), (F.col("doc_id") % 3).alias("c"), (-F.col("score") * 10).alias("ll"))


@query(_CL + "SELECT q, c, round(ln(m / sum(m) OVER (PARTITION BY q)), 6) AS log_share FROM (SELECT q, c, sum(exp(ll)) AS m FROM g GROUP BY ALL)")
def logsumexp(spark, d):
    return r6(sc.log_mean_exp(clustered(spark, d), "q", "c", "ll"), "log_share")


@query(_CL + """, s AS (SELECT q, c, m / sum(m) OVER (PARTITION BY q) AS p, n::DOUBLE / sum(n) OVER (PARTITION BY q) AS a FROM (SELECT q, c, sum(exp(ll)) AS m, count(*) AS n FROM g GROUP BY ALL)),
e AS (SELECT q, -sum(p * ln(p)) AS rao, -sum(a * ln(a)) AS assigned FROM s GROUP BY 1), m AS (SELECT q, -avg(ll) AS mc, count(*) AS n FROM g GROUP BY 1)
SELECT q, round(mc, 6) AS mc, n, round(rao, 6) AS rao, round(assigned, 6) AS assigned FROM m JOIN e USING (q)""")
def cluster_entropy(spark, d):
    return r6(sc.entropies(clustered(spark, d), "q", "c", "ll"), "mc", "rao", "assigned")


def _trim(name: str, source: str) -> str:
    quart = "list_extract(s, len(s) // 4 + 1)", "list_extract(s, 3 * len(s) // 4 + 1)"
    bounds = f"{quart[0]} - 2.0 * ({quart[1]} - {quart[0]})", f"{quart[1]} + 2.0 * ({quart[1]} - {quart[0]})"
    return f", {name} AS (SELECT q, CASE WHEN len(s) < 3 THEN s ELSE list_filter(s, lambda x: x >= {bounds[0]} AND x <= {bounds[1]}) END AS s FROM {source})"


@query(L + ", r0 AS (SELECT doc_id % 20 AS q, list_sort(list(len)) AS s FROM l GROUP BY 1)" + "".join(_trim(f"r{k + 1}", f"r{k}") for k in range(5)) + " SELECT q, round(list_sum(s) / len(s), 6) AS mean, len(s)::INTEGER AS kept FROM r5")
def iqr_trim(spark, d):
    return r6(sc.trimmed_mean(labelled(spark, d).withColumn("q", F.col("doc_id") % 20), "q", "len"), "mean")


@query(_CL + "SELECT q, round(exp(-avg(ll)), 6) AS perplexity FROM g GROUP BY 1")
def answer_perplexity(spark, d):
    return r6(sc.answer_perplexity(clustered(spark, d), "q", "ll"), "perplexity")


@query(L + "SELECT doc_id % 40 AS q, round(sum(exp(-score) * score) / sum(exp(-score)), 6) AS soft, round(sum(CASE WHEN quality = 1 THEN exp(-score) ELSE 0.0 END) / sum(exp(-score)), 6) AS hard FROM l GROUP BY 1")
def semantic_perplexity(spark, d):
    told = labelled(spark, d).select((F.col("doc_id") % 40).alias("q"), F.exp(-F.col("score")).alias("lik"), F.col("score").alias("agree"), F.col("quality").alias("ours"))
    return r6(sc.semantic_perplexity(told, "q", "lik", "agree", "ours"), "soft", "hard")


@query(L + "SELECT source, epoch, round(sum(score), 6) AS total, round(avg(score), 6) AS mean FROM (SELECT *, doc_id % 4 AS epoch FROM l) GROUP BY ALL")
def epoch_totals(spark, d):
    per = labelled(spark, d).withColumn("epoch", F.col("doc_id") % 4).groupBy("source", "epoch")
    return r6(per.agg(F.sum("score").alias("total"), F.avg("score").alias("mean")), "total", "mean")


@query(L + ", s AS (SELECT doc_id % 8 AS part, sum(len) AS total FROM l GROUP BY 1) SELECT min(total) AS least, max(total) AS most, max(total) - min(total) AS diff FROM s")
def partition_imbalance(spark, d):
    per = labelled(spark, d).groupBy((F.col("doc_id") % 8).alias("part")).agg(F.sum("len").alias("total"))
    return per.agg(F.min("total").alias("least"), F.max("total").alias("most"), (F.max("total") - F.min("total")).alias("diff"))


@query(L + "SELECT round(avg(score), 6) AS mean, max(score) AS max, min(score) AS min, round(avg((score >= 0.98)::INT), 6) AS clip_ratio, round(1 - var_samp(score - quality) / (var_samp(score) + 1e-5), 6) AS explained_variance FROM l")
def batch_metrics(spark, d):
    s, v = F.col("score"), F.col("quality")
    out = labelled(spark, d).agg(F.avg(s).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.avg((s >= 0.98).cast("double")).alias("clip_ratio"), (1 - F.var_samp(s - v) / (F.var_samp(s) + 1e-5)).alias("explained_variance"))
    return r6(out, "mean", "clip_ratio", "explained_variance")
