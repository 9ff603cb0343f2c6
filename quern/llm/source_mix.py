"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

The j-th block of a source of weight w (weights sum to 1) may not come before its release floor(j / w) and has to come
before its deadline ceil((j + 1) / w); in each slot the released block with the earliest deadline goes, ties to the
larger weight and then by name. Any prefix of the mix then holds less than one block more or less of a source than its
weight says, however long the mix. Weights are taken as they are, in whole numbers, and the driver schedules the whole mix, a
step a block; only counts of blocks come to it, and rows find their slot by a join.
"""

from __future__ import annotations

import heapq
import math
from array import array
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written


@dataclass(frozen=True)
class Mix:
    """block: documents in a block. slots: in how many of them shares are told. power: where no weights are given
    a source weighs its rows to this power. once: each block goes once, and later slots of a source that has run out stay empty;
    else the mix goes on until each source has been read whole, and shorter sources start again."""

    block: int = 64
    slots: int = 1000
    power: float = 0.7
    once: bool = False
    bucket: int = 1024


#: A schedule of so many blocks is small enough to be sent to every executor; longer ones are written in parts of so many.
BROADCAST_SLOTS = 1 << 19


def shares(sizes: DataFrame, params: Mix, weights: dict[str | None, float] | None) -> DataFrame:
    """source, n, blocks, share (its weight's part of slots, not rounded) for sizes (source, n), which has a row a source.
    Weights of sources without rows are left out; a source without a weight gets the smallest given one, and one of
    weight 0 has no place in the mix."""
    if weights:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]) if any(k is not None for k in weights) else None
        least = float(min(weights.values()))
        known = F.coalesce(named[F.col("source")], F.lit(least)) if named is not None else F.lit(least)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, least)))).otherwise(known)
    else:
        weight = F.pow(F.col("n"), F.lit(params.power))
    share = params.slots * F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("weight", weight).filter("weight > 0").select("source", "n", F.ceil(F.col("n") / params.block).cast("long").alias("blocks"), share.alias("share"))


def schedule(share: list[float], blocks: list[int]) -> tuple[array, array]:
    """(source, which of its blocks) by slot, until each source has gone `blocks` times. Earliest deadline first among the
    released; sources are in the order in which ties are broken. Windows are of whole numbers, so no rounding shifts them."""
    exact = [Fraction(x) for x in share]
    unit = math.lcm(*(x.denominator for x in exact)) if exact else 1
    parts = [int(x * unit) for x in exact]
    whole, k, left = sum(parts), [0] * len(parts), sum(n > 0 for n in blocks)
    waiting, ready = [(0, i) for i in range(len(parts))], []
    who, which, t = array("i"), array("q"), 0
    while left:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(k[i] + 1) * whole // parts[i]), i))
        i = heapq.heappop(ready)[1]
        who.append(i)
        which.append(k[i])
        k[i] += 1
        left -= k[i] == blocks[i]
        heapq.heappush(waiting, (k[i] * whole // parts[i], i))
        t += 1
    return who, which


def ranked(df: DataFrame, source: str, order: Column, bucket: int) -> DataFrame:
    """df with __s (its source, never null) and __rank, its place among the rows of its source by a hash of order (from
    0), without all rows of a source in a task.

    Rows go to hash buckets within their source, and buckets to groups; counts of both are summed first, and a row's
    place is what stands before its group, its bucket and itself. Rows are dealt once, by source and bucket."""
    side = max(1, round((df.count() / bucket) ** 0.5))
    name = F.when(F.col(f"`{source}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(f"`{source}`").cast("string")))
    told = df.withColumn("__s", name).withColumn("__key", F.xxhash64(order))
    told = told.withColumn("__g", F.pmod(F.shiftrightunsigned("__key", 8), F.lit(side))).withColumn("__b", F.pmod(F.xxhash64(F.col("__key"), F.lit(1)), F.lit(side)))
    keys = ["__s", "__g", "__b"]
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = told.groupBy(*keys).agg(F.count("*").alias("__n"))
    inner = sums.withColumn("__in", before(Window.partitionBy("__s", "__g").orderBy("__b"))).drop("__n")
    groups = sums.groupBy("__s", "__g").agg(F.sum("__n").alias("__n")).withColumn("__at", before(Window.partitionBy("__s").orderBy("__g"))).drop("__n")
    starts = inner.join(groups, ["__s", "__g"]).select(*keys, (F.col("__in") + F.col("__at")).alias("__before"))
    placed = told.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__key", order)) - 1)
    return placed.join(starts, keys).select(*[F.col(f"`{c}`") for c in df.columns], "__s", (F.col("__r") + F.col("__before")).alias("__rank"))


def source_mix(df: DataFrame, source: str = "source", order: str = "doc_id", weights: dict[str | None, float] | None = None, params: Mix | None = None) -> DataFrame:
    """df with slot (the block's place in the mix), block (of the source), pass (0, 1 ... for a source read again), all
    long, and place (of the row in its block, int).

    Rows of a source are in the order of a hash of `order`, ties by `order` itself; repeated rows are rows like others. Null
    is a source of its own. Without `once` the mix ends in the slot in which the last source
    has been read to its end. An empty table gives an empty one. Columns of df with these names are replaced.
    """
    params = params or Mix()
    made = ("slot", "block", "pass", "place")
    own = [F.col(f"`{c}`") for c in df.columns if c not in made]
    sizes = df.groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    told = sorted(shares(sizes, params, weights).collect(), key=lambda r: (-r["share"], r["source"] is not None, r["source"] or ""))  # a row a source
    who, which = schedule([r["share"] for r in told], [r["blocks"] for r in told])
    jobs = np.bincount(np.frombuffer(who, dtype=np.int32), minlength=len(told)) if who else np.zeros(len(told), dtype=np.int64)
    name = ["-" if r["source"] is None else "+" + r["source"] for r in told]
    shared = pa.table({"__s": pa.array(name, pa.string()), "__i": pa.array(range(len(told)), pa.int32()), "__blocks": pa.array([r["blocks"] for r in told], pa.int64()), "__jobs": pa.array(jobs, pa.int64())})
    shared = written(spark.createDataFrame(shared))
    ranges = [slice(at, at + BROADCAST_SLOTS) for at in range(0, max(len(who), 1), BROADCAST_SLOTS)]
    parts = [spark.createDataFrame(pa.table({"__i": pa.array(who[x], pa.int32()), "__j": pa.array(which[x], pa.int64()), "slot": pa.array(range(x.start, min(x.stop, len(who))), pa.int64())})) for x in ranges]
    plan = written(reduce(DataFrame.unionAll, parts))
    if len(who) <= BROADCAST_SLOTS:
        plan = F.broadcast(plan)
    placed = ranked(df.select(*own), source, F.col(f"`{order}`"), params.bucket)
    placed = placed.withColumn("__block", F.floor(F.col("__rank") / params.block)).join(shared, "__s")
    turns = F.lit(1) if params.once else F.ceil((F.col("__jobs") - F.col("__block")) / F.col("__blocks")).cast("long")
    read = placed.withColumn("__pass", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1))).withColumn("__j", F.col("__block") + F.col("__pass") * F.col("__blocks"))
    return read.join(plan, ["__i", "__j"]).select(*own, "slot", F.col("__block").alias("block"), F.col("__pass").alias("pass"), (F.col("__rank") % params.block).cast("int").alias("place"))
