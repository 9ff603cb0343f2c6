"""What the findings of r03 were about."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.operators import neighbours as nb
from quern.operators import retrieval as rt


def test_mean_similarity_makes_no_row_a_pair(spark):
    """Entities with missing items, an item without values and one of a single value; blocks of several sizes."""
    random.seed(3)
    rows = [(u, i, random.choice([None, random.gauss(u % 5, 2)])) for u in range(60) for i in "abc" if (u + ord(i)) % 4 for _ in range(3)]
    rows += [(u, "d", None) for u in range(9)] + [(u, "e", 4.0) for u in range(5, 12)] + [(99, "z", 1.0), (None, "a", 1.0), (3, None, 2.0)]
    series = spark.createDataFrame(rows, "u long, i string, v double")
    pairs = rt.similarity(series, "u", "i", "v").withColumn("similarity", F.round("similarity", 6))
    want = {r["same"]: r["mean"] for r in pairs.groupBy((F.col("a") % 2 == F.col("b") % 2).alias("same")).agg(F.avg("similarity").alias("mean")).collect()}
    for block in (8192, 7):
        out = nb.mean_similarity(series, "u", "i", "v", F.col("entity") % 2, block=block)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert {r["same"]: round(r["mean"], 9) for r in out.collect()} == {k: round(x, 9) for k, x in want.items()}
    assert nb.mean_similarity(series.limit(0), "u", "i", "v", F.col("entity") % 2).count() == 0


def test_best_of_rows_sorts_few_scores(monkeypatch):
    """Ties, scores that only rounding makes equal, and scores that are no numbers; of a large block few scores are sorted."""
    rng = np.random.default_rng(1)
    for n, k, digits in ((3000, 5, 5), (3000, 5, None), (3000, 5, 1), (12, 5, 2), (3, 5, 2), (0, 5, 2)):
        scores = np.round(rng.normal(size=(40, n)), 3)
        if n == 12:
            scores[3, 4] = np.nan
        rounded = scores if digits is None else np.round(scores, digits)
        top = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
        at, column, score = rt._best_of_rows(scores, k, digits)
        assert column.tolist() == top.ravel().tolist() and at.tolist() == np.repeat(np.arange(40), top.shape[1]).tolist()
        assert np.array_equal(score, np.take_along_axis(rounded, top, axis=1).ravel(), equal_nan=True)
    sorted_ = []
    was = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or was(keys))
    d = pd.DataFrame({"doc_id": range(8192), "v": list(rng.normal(size=(8192, 8)))})
    q = pd.DataFrame({"query_id": range(100), "v": list(rng.normal(size=(100, 8)))})
    assert len(rt.block_product(5, 5)(d, q)) == 500 and 0 < sum(sorted_) < 5000
