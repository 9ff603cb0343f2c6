"""Queries whose rows no SQL gives: models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quern.operators import ml, sampling
from quern.operators import timeseries as ts
from quern.plans.registry import query
from quern.plans.relational import t
from quern.plans.series import KEYS, filled


@query()
def risk_model(spark, d):
    stats = ts.series_stats(filled(spark, d), KEYS)
    items = ["click", "error", "purchase", "signup", "view"]
    people = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 2).cast("double").alias("gender"), F.col("c_acctbal").alias("age"))
    codes = t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("code"))
    table = ml.feature_table(stats, "user_id", "event_type", items, people, codes).withColumn("label", (F.col("user_id") % 2).cast("double"))
    split = sampling.hash_split(table, "user_id", {"train": 80, "test": 20})
    features = [f"{i}_{s}" for i in items for s in ml.STATS] + ["age", "gender", "n_codes"]
    model = ml.fit(split.filter("split = 'train'"), features, "label", "logistic")
    return model.transform(split.filter("split = 'test'")).select("user_id", "label", vector_to_array("probability")[1].alias("risk"), "prediction")
