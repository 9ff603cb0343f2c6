"""Queries over cohorts and histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import cohort as co
from quern.plans.registry import query


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("SELECT c_custkey AS subject_id, c_name AS name, 'unknown' AS race FROM customer")
def rename_project(spark, d):
    names = {"c_custkey": "subject_id", "c_name": "name", "missing": "gone"}
    return co.renamed(t(spark, d, "customer"), names, {"race": F.lit("unknown")}).select("subject_id", "name", "race")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000")
def version_filter(spark, d):
    return t(spark, d, "orders").filter("o_orderstatus = 'O' AND o_totalprice >= 200000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_filter(spark, d):
    keys = t(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return co.semi(t(spark, d, "orders"), keys, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def anti_filter(spark, d):
    done = t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return co.anti(t(spark, d, "customer"), done, "c_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') = false) ON l_orderkey = o_orderkey")
def array_overlap_filter(spark, d):
    golds = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("golds"))
    kept = golds.filter(~F.arrays_overlap("golds", F.array(F.lit("R"))))
    return t(spark, d, "orders").join(kept, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_left(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return co.enrich(o, (t(spark, d, "customer"), "c_custkey"), (n, "c_nationkey"), (t(spark, d, "region"), "r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT p_partkey, coalesce(a.n_name, b.n_name, c.n_name) AS category FROM part LEFT JOIN nation a ON a.n_nationkey::VARCHAR = p_partkey::VARCHAR
  LEFT JOIN nation b ON b.n_nationkey::VARCHAR = p_size::VARCHAR LEFT JOIN nation c ON c.n_nationkey::VARCHAR = ltrim(right(p_partkey::VARCHAR, 2), '0')""")
def fallback_lookup(spark, d):
    code = F.col("p_partkey").cast("string")
    forms = [code, F.col("p_size").cast("string"), F.ltrim(F.right(code, F.lit(2)), F.lit("0"))]
    table = t(spark, d, "nation").withColumn("code", F.col("n_nationkey").cast("string"))
    return co.fallback_lookup(t(spark, d, "part"), "p_partkey", forms, table, "code", "n_name", "category").select("p_partkey", "category")


@query("SELECT a.o_orderkey, b.o_orderkey AS prior, b.o_orderdate AS prior_time FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate")
def prior_admissions(spark, d):
    return co.priors(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("""SELECT o_orderkey, place::INTEGER AS place, prior FROM (SELECT a.o_orderkey, b.o_orderkey AS prior, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC) AS place
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate) WHERE place <= 10""")
def last10_prior(spark, d):
    return co.latest_priors(t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 10)


@query("""WITH a AS (SELECT user_id, min(event_id) AS anchor, min(ts) + INTERVAL 2 DAY AS start FROM events GROUP BY 1)
SELECT anchor, event_type, arg_min(value, (ts, event_id)) AS value FROM a JOIN events e USING (user_id) WHERE e.ts >= a.start AND value IS NOT NULL GROUP BY ALL""")
def first_after(spark, d):
    e = t(spark, d, "events")
    a = e.groupBy("user_id").agg(F.min("event_id").alias("anchor"), (F.min("ts") + F.expr("INTERVAL 2 DAYS")).alias("start"))
    return co.first_after(a, e.filter("value IS NOT NULL"), "user_id", "start", "ts", "event_type", "anchor", "value", "event_id")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1 + c_custkey % 3")
def nth_join(spark, d):
    o = co.nth(t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    c = t(spark, d, "customer").withColumn("nth", (1 + F.col("c_custkey") % 3).cast("int")).withColumnRenamed("c_custkey", "o_custkey")
    return c.join(o, ["o_custkey", "nth"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS stays FROM orders GROUP BY 1")
def bridge_list(spark, d):
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(ids, ",").alias("stays"))


@query("""SELECT l_orderkey, array_to_string((list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey))[1:5], ',') AS items, coalesce(min(CASE WHEN l_linenumber = 1 THEN l_partkey END), -1) AS lead FROM lineitem GROUP BY 1""")
def ordered_struct_list(spark, d):
    out = co.ordered_list(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", first=5)
    return out.select("l_orderkey", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.coalesce("lead", F.lit(-1)).alias("lead"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS codes FROM orders GROUP BY 1")
def sorted_code_set(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("codes"))


@query("SELECT source, count(*) AS n, sum(quality)::BIGINT AS positives, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def class_rate(spark, d):
    both = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id")
    return r6(both.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("positives"), F.avg("quality").alias("rate")), "rate")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey % 10) AS gold FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 10) AS found FROM lineitem GROUP BY 1)
SELECT k, round(len(list_intersect(gold, found)) / len(gold), 6) AS recall FROM g JOIN p USING (k)""")
def intersect_recall(spark, d):
    l = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("gold"), F.collect_set(F.col("l_partkey") % 10).alias("found"))  # noqa: E741
    return r6(l.select("k", (F.size(F.array_intersect("gold", "found")) / F.size("gold")).alias("recall")), "recall")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def except_remaining(spark, d):
    return t(spark, d, "customer").select("c_custkey").subtract(t(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_pairs(spark, d):
    return t(spark, d, "events").select("user_id", "event_type").distinct()


@query("SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max, quantile_cont(n, 0.5)::DOUBLE AS median FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)")
def population_stats(spark, d):
    return r6(co.stats_of_counts(t(spark, d, "orders"), "o_custkey", "o_orderpriority"), "mean", "std")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS entities FROM events WHERE value > 50")
def distinct_entities(spark, d):
    return t(spark, d, "events").filter("value > 50").agg(F.countDistinct("user_id").alias("entities"))


@query("SELECT event_id, user_id::VARCHAR || '_' || event_type AS patient_id FROM events")
def composite_key(spark, d):
    return t(spark, d, "events").select("event_id", F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("patient_id"))


@query("SELECT o_orderkey, o_custkey AS question, o_orderpriority AS style FROM orders")
def nested_projection(spark, d):
    nested = t(spark, d, "orders").select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("question")).alias("ground_truth"), F.col("o_orderpriority").alias("style")).alias("reward_model"))
    return nested.select("o_orderkey", "reward_model.ground_truth.question", "reward_model.style")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'none' END AS answer FROM orders")
def first_non_null(spark, d):
    even, third = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(even, third, F.lit("none")).alias("answer"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS code FROM orders")
def category_encode(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(-1).alias("code"))


@query("SELECT doc_id, lang, coalesce(quality, -1)::INTEGER AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def cache_lookup(spark, d):
    cache = t(spark, d, "labels").select("doc_id", "quality")
    return t(spark, d, "documents").select("doc_id", "lang").join(cache, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)")
def hard_examples(spark, d):
    return co.anti(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")


@query("""SELECT user_id, nth::INTEGER AS nth, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY m, event_id) AS nth FROM (SELECT user_id, event_type, min(event_id) AS event_id, min(event_id) AS m FROM events GROUP BY ALL))""")
def keep_first_renumber(spark, d):
    e = t(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    kept = e.select("user_id", "event_id", place.alias("p")).filter("p = 1")
    return co.nth(kept, "user_id", ["event_id"]).select("user_id", "nth", "event_id")


@query("SELECT o_orderkey, CASE WHEN c_acctbal = 0 THEN NULL ELSE round(c_acctbal + (year(o_orderdate) - 1990), 6) END AS age FROM orders JOIN customer ON c_custkey = o_custkey")
def age_at_event(spark, d):
    both = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", F.round(F.when(F.col("c_acctbal") != 0, F.col("c_acctbal") + (F.year("o_orderdate") - 1990)), 6).alias("age"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def argsort_top20(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
