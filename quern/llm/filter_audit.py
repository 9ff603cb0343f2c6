"""What each filter of a chain takes, in every order, from counts of outcomes alone.

A document fails a set of filters: a mask of five bits. A part's documents are three rows of 32 counts (all of them, those of
good quality, toxic ones). Whether a mask is kept, removed, redundant or unique at a step of an order says an integer matrix
of 32 masks by 600 steps (120 orders of five); the rows times these matrices are the whole audit, whatever the documents number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_rules(text: Column) -> list[Column]:
    """Failure of A (under 200 words), B (under half of the words are distinct), C (over 3 % of the code points are A-Z) and
    D (holds one of # $ % & * |), in this order."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    n = F.size(words).cast("long")
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: 32 masks by 600 (order, step), 0 or 1."""
    order = np.array(list(permutations(range(len(LETTERS)))))
    bit = 1 << order
    before = (np.cumsum(bit, axis=1) - bit).ravel()
    bit, mask = bit.ravel(), np.arange(MASKS)[:, None]
    fails, earlier = (mask & bit) != 0, (mask & before) != 0
    told = {"kept": ~(fails | earlier), "removed": fails & ~earlier, "redundant": fails & earlier, "unique": mask == bit}
    return {k: v.astype(np.int64) for k, v in told.items()}


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just the filters of a mask, and how many of them are labelled.

    docs: doc_id, lang, text; labels: doc_id, quality, toxic. What the rules say of a text depends on it alone, so all that is
    shuffled is a digest of 32 bytes with ids and counts, added up before each shuffle: copies by the thousand are one row a task."""
    text = F.coalesce("text", F.lit(""))
    rules = text_rules(text)
    mask = sum((F.when(r, 1 << k).otherwise(0) for k, r in enumerate(rules[1:], 1)), F.when(rules[0], 1).otherwise(0))
    told = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    each = told.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("q"), F.max((F.col("toxic") == 1).cast("long")).alias("x"))
    each = each.join(marks, "doc_id", "left").withColumn("good", F.col("n") * F.coalesce("q", F.lit(0))).withColumn("toxic", F.col("n") * F.coalesce("x", F.lit(0)))

    sums = lambda when: F.struct(*[F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(c) for c in ("n", "good", "toxic")])
    first = F.min_by(F.struct("n", "good", "toxic"), F.col("doc_id"))
    texts = each.groupBy("digest", "part", "mask").agg(sums(F.lit(True)).alias("all"), sums(F.col("doc_id").isNull()).alias("free"), first.alias("first"), F.min("doc_id").alias("low"))
    texts = texts.withColumn("lowest", F.min("low").over(Window.partitionBy("digest")))  # a row a part is left of each text
    original = [(F.col("free")[c] + F.when(F.col("low") == F.col("lowest"), F.col("first")[c]).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    copies = [(F.col("all")[c.name] - F.col("orig")[c.name]).alias(c.name) for c in texts.schema["all"].dataType]
    split = texts.select("part", "mask", "all", F.struct(*original).alias("orig")).select("part", F.explode(F.array(F.struct("mask", "orig"), F.struct((F.col("mask") + 16).alias("mask"), F.struct(*copies).alias("orig")))).alias("x"))
    rows = split.select("part", F.col("x.mask").alias("mask"), "x.orig.*").filter("n > 0")
    return rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    Filter E fails a text that a smaller doc_id has as well, anywhere in the table; two texts are the same if their SHA-256 is.
    A null text is empty, a null lang the part of the empty string; a row without a doc_id is no copy of any other and makes
    none. Repeated rows count each, and have no copy in each other. A document is of good quality (toxic) if any of its labels
    says so; labels without a document say nothing. An empty table has no parts, so no rows. Further columns are not read."""
    counts = mask_counts(docs.select("doc_id", "lang", "text"), labels.select("doc_id", "quality", "toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("told"))
    orders = ["".join(x) for x in permutations(LETTERS)]
    names = [x for x in orders for _ in LETTERS]
    steps = list(range(1, len(LETTERS) + 1)) * len(orders)

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = outcome_matrices()
        filters = np.array([LETTERS.index(order[s - 1]) for order, s in zip(names, steps, strict=True)])
        by_filter = np.eye(len(LETTERS), dtype=np.int64)[filters]  # 600 steps by five filters
        for batch in batches:
            for part, told in zip(batch["part"].to_pylist(), batch["told"].to_pylist(), strict=True):
                stack = np.zeros((3, MASKS), dtype=np.int64)
                for x in told:
                    stack[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                removed = stack @ m["removed"]
                shapley = (removed[0] @ by_filter)[filters]
                counts = [stack[0] @ m["kept"], removed[0], stack[0] @ m["redundant"], stack[0] @ m["unique"], removed[1], removed[2], shapley]
                columns = [pa.array([part] * len(names)), pa.array(names), pa.array(steps, pa.int32()), *map(pa.array, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
