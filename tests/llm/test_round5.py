"""What the findings of the third round's check were about, in operators for training data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.llm import context_mixing
from quern.llm import jaccard_join as jj


def test_a_task_of_the_join_has_one_python_worker(spark):
    p = jj.Join(cell_bits=8)
    texts = [" ".join(f"w{k * n % 97}" for n in range(3 + k % 20)) for k in range(1, 40)]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + k, t) for k, t in enumerate(texts[:9])), (200, "")], "id long, text string").withColumn("th", F.xxhash64("text"))
    rows = jj._read(docs, p).filter("chunk is null").select("id", "th", "n", "node").localCheckpoint()
    classes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("th", "id")).alias("one"), F.count("*").alias("times")).localCheckpoint()
    heads = jj._heads(docs, rows, classes, np.zeros(256, dtype=np.uint8), p)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert sorted(r["node"] for r in heads.collect()) == sorted(r["node"] for r in classes.collect())


def test_the_mixer_learns_in_steps_within_a_window(monkeypatch):
    """A window's counts are read at once, and its weights still take a step of 1,024 words at a time."""
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, 40)
    coder = context_mixing.Coder(np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64)), counts, int(counts.sum()) + 17, context_mixing.Model(coded=30))
    symbols, contexts = rng.integers(0, 31, 5000).astype(np.int32), rng.integers(0, 1 << 32, (5, 5000)).astype(np.uint32)
    tables = rng.integers(0, 65536, (5, 1024)).astype(np.uint16)

    def learnt(slices):
        model = context_mixing.Trained(coder, tables, context_mixing._start(), np.zeros(0), 10)
        saw, hits, reads = np.zeros(16, dtype=np.int64), np.zeros(2 * 256 * 129, dtype=np.int64), []
        was = model.inputs
        monkeypatch.setattr(model, "inputs", lambda *x: reads.append(1) or was(*x))
        for s in slices:
            context_mixing.learn(model, symbols[s], contexts[:, s], 0.04, saw, hits)
        return model.weights, saw, hits, len(reads)

    *want, steps = learnt([slice(a, a + 1024) for a in range(0, 5000, 1024)])
    *got, windows = learnt([slice(0, 5000)])
    assert (steps, windows) == (5, 2)
    assert all((x == y).all() for x, y in zip(got, want, strict=True))
    assert got[1].sum() == got[2].sum() == coder.lengths[symbols].sum()
