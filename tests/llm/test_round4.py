"""What the findings of r03 were about, in operators for training data."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import context_mixing
from quern.llm import jaccard_join as jj


def test_the_mixer_learns_from_all_training_texts(spark, monkeypatch):
    m = context_mixing.Model(coded=60, known=200, slot_bits=10, task_words=3000, learn_words=500, common=8, anchor=2)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 7 + k * k) % 90) for k in range(20)]).alias("text"))
    seen, was = [], context_mixing._mixer
    monkeypatch.setattr(context_mixing, "_mixer", lambda told, *rest: seen.append(told.count()) or was(told, *rest))
    out = context_mixing.lm_scores(docs, params=m).collect()
    assert seen == [sum(not r["held_out"] for r in out)]


def copies(spark):
    """Texts with copies, near copies, repeated rows, one id twice, null ids, and texts without words."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(r.choice((3, 12, 60)))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(200 + k, t) for k, t in enumerate(texts[:40])] + [(300 + k, t + " end") for k, t in enumerate(texts[20:80])]
    rows += [(7, texts[7])] * 2 + [(7, texts[90]), (None, texts[3]), (None, "all alone with a null id"), (None, "all alone with a null id"), (400, None), (401, " \n"), (401, " \n")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_counts_of_shingles_follow_the_input(spark):
    sized = lambda n: spark.range(4).select(F.expr(f"repeat('a ', {n})").alias("text"))
    assert [jj._cell_bits(sized(n), jj.Join()) for n in (10, 1 << 21, 1 << 22)] == [18, 19, 20] and jj._cell_bits(sized(1 << 22), jj.Join(cell_bits=12)) == 12
    # frequent shingles still come after rare ones where all cells are in use: with steps of an octave, 240 and 300 were alike
    read = spark.createDataFrame([(k, bytearray(jj._sparse(np.array([240, 300])))) for k in range(jj._CHUNKS)], "chunk int, cells binary")
    told = jj._cells(read, jj.Join(cell_bits=9)).reshape(-1, 2)
    assert (told[:, 0] < told[:, 1]).all()


def test_large_tables_are_joined_as_small_ones(spark):
    docs = copies(spark).cache()
    small = [sorted(map(str, jj.jaccard_groups(docs).collect()))]
    large = [sorted(map(str, jj.jaccard_groups(docs, params=jj.Join(broadcast_rows=0, mark_bits=bits)).collect())) for bits in (12, 27)]
    assert large == small * 2


def test_one_of_each_of_large_tables(spark):
    docs = copies(spark).cache()
    small = sorted(map(str, jj.one_of_each(docs).collect()))
    assert [sorted(map(str, jj.one_of_each(docs, params=jj.Join(broadcast_rows=0, mark_bits=bits)).collect())) for bits in (12, 27)] == [small] * 2


def test_marked_documents(spark):
    docs = spark.range(1000).select("id", F.col("id").alias("th"))
    wanted, other = docs.filter("id % 3 = 0"), docs.filter("id % 3 > 0")
    for bits in (12, 24):
        p = jj.Join(mark_bits=bits)
        told = {r["id"]: r["__sure"] for r in jj._sifted(docs, "th", "id", jj._marks(wanted, "th", "id", p), jj._marks(other, "th", "id", p), p).collect()}
        assert {k for k in range(0, 1000, 3)} <= told.keys() and all(k % 3 == 0 for k, sure in told.items() if sure)
    assert told == {k: True for k in range(0, 1000, 3)}


def test_tasks_of_the_mixer_run_at_once(spark, monkeypatch):
    m = context_mixing.Model(coded=60, known=200, slot_bits=10, common=8, anchor=2)
    docs = spark.range(0, 60, 1, 6).select(F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 7 + k * k) % 90) for k in range(20)]).alias("text"))
    words, tasks, was = context_mixing.count_words(docs).localCheckpoint(), [], context_mixing.written
    monkeypatch.setattr(context_mixing, "written", lambda df: tasks.append((df.columns, df.rdd.getNumPartitions())) or was(df))
    context_mixing.train(docs, words, words.agg(F.sum("c")).first()[0], m)
    assert (["weights", "saw", "hits"], 6) in tasks
