"""Deterministic splits and samples by hashes of keys, and balanced partitions."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import md5_order, number_order, with_place


def bucket(key: Column, seed: int = 42, of: int = 100) -> Column:
    """A bucket in [0, of) from md5 of key and seed: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % of


def hash_split(df: DataFrame, entity: str, shares: dict[str, int]) -> DataFrame:
    """split per entity, shares in percent: all rows of an entity go the same way, without any shuffle."""
    b, low, out = bucket(F.col(entity)), 0, F.lit(None).cast("string")
    for name, share in shares.items():
        out = F.when((b >= low) & (b < low + share), name).otherwise(out)
        low += share
    return df.withColumn("split", out)


def stratified_split(df: DataFrame, label: str, key: str, shares: list[tuple[str, float]]) -> DataFrame:
    """Each label's rows in hash order, cut at the shares of its count."""
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))  # a row a label
    told = with_place(df, [label], md5_order(key))
    told = told.join(sizes, F.col(f"`{label}`").eqNullSafe(F.col("__l")))
    out = F.lit(shares[-1][0])
    for i in range(len(shares) - 2, -1, -1):
        out = F.when(F.col("__place") < F.floor(F.col("__n") * sum(s for _, s in shares[: i + 1]) + 1e-9), shares[i][0]).otherwise(out)
    return told.withColumn("split", out).drop("__place", "__l", "__n")


def undersample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Every label cut to the size of the smallest."""
    return cap_per_source(df, label, key, df.groupBy(label).count().agg(F.coalesce(F.min("count"), F.lit(0))).first()[0])


def cap_per_source(df: DataFrame, source: str, key: str, cap: int) -> DataFrame:
    """The first `cap` rows of each source in hash order."""
    return with_place(df, [source], md5_order(key)).filter(F.col("__place") < cap).drop("__place")


def uniform_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in hash order."""
    bucket, order = md5_order(key)
    return df.orderBy(*order).limit(n) if n <= 10_000 else with_place(df, [], (bucket, order)).filter(F.col("__place") < n).drop("__place")


def positional_split(df: DataFrame, key: str, cuts: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """train, validation and test by position in the order of a unique number."""
    n = df.count()
    at = [int(n * c) for c in cuts]
    told = with_place(df, [], number_order(df, key))
    return told.withColumn("split", F.when(F.col("__place") < at[0], "train").when(F.col("__place") < at[1], "validation").otherwise("test")).drop("__place")


def drop_half(df: DataFrame, key: str, right: Column) -> DataFrame:
    """Without half of the rows that are right already, by hash order."""
    some = df.filter(right)
    gone = some.withColumn("__b", bucket(F.col(key), of=2)).filter("__b = 0").select(key)
    return df.join(gone, key, "left_anti")


def longest_first(lengths: list[tuple[int, int]], k: int) -> list[int]:
    """Totals of k parts when items go, longest first, each to the least loaded part (of equal ones the first). lengths: (length,
    how many items have it). Where all loads are nearer than a length, a round gives each part one item, so rounds go at once."""
    heap = [(0, part) for part in range(k)]
    for length, n in sorted(lengths, reverse=True):
        while n:
            if n >= k and max(heap)[0] - heap[0][0] < length:
                heap = [(load + n // k * length, part) for load, part in heap]
                n %= k
            else:
                load, part = heap[0]
                heapq.heapreplace(heap, (load + length, part))
                n -= 1
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def greedy_partition(df: DataFrame, length: str, k: int) -> DataFrame:
    """part, total of `longest_first`. What is sorted and dealt are the distinct lengths with their counts, which rows are added up to
    where they lie; null lengths are 0."""
    counts = df.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n"))
    told = lambda pdf: pd.DataFrame({"part": range(k), "total": longest_first(list(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True)), k)})
    return counts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(told, "part int, total long")


def karmarkar_karp(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Indices of k parts whose sums are close, by largest differencing; equal: of the same number of items.

    The two solutions of widest spread are put together, the largest parts of one with the smallest of the other. Only parts that
    hold an item are kept, largest first; the others are empty."""
    if equal and len(lengths) % k:
        raise ValueError("the number of items has to be a multiple of k")
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    batches = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    spread = lambda parts: (parts[-1][0] if len(parts) == k else 0) - parts[0][0]
    heap: list[tuple] = []
    for n, batch in enumerate(batches):
        parts = sorted(([lengths[i], [i]] for i in batch), key=lambda p: -p[0])
        heapq.heappush(heap, (spread(parts), n, parts))
    n = len(batches)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        p, q = len(a), k - len(b)  # places from q on have a part of b, its last one first
        both = [a[i] if i < q else b[k - 1 - i] if i >= p else [a[i][0] + b[k - 1 - i][0], a[i][1] + b[k - 1 - i][1]] for i in [*range(p), *range(max(p, q), k)]]
        n += 1
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (spread(both), n, both))
    parts = [sorted(p[1]) for p in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def _parted(df: DataFrame, batch: str, key: str, length: str, parts: Column, equal: bool, room: int) -> DataFrame:
    """batch, key, length, part, parts. Batches of up to `room` rows are balanced whole. The rows of a larger one are dealt in the
    order of their lengths to as many lanes as there are parts, and lanes that together hold up to `room` rows are balanced by
    themselves; where not even two of them do, a lane is a part. Sums differ by two longest rows at most."""
    sizes = df.groupBy(F.col(batch).alias("__batch")).agg(F.count("*").alias("__n"), F.sum(F.coalesce(F.col(length), F.lit(0))).alias("__sum"))
    sizes = sizes.withColumn("parts", parts.cast("long")).withColumn("__wide", F.greatest(F.least(F.floor(F.lit(room) * F.col("parts") / F.col("__n")), F.col("parts")), F.lit(1)))
    if equal:
        even = F.when(F.col("__n") % F.col("parts") == 0, True).otherwise(F.raise_error(F.lit("the number of rows has to be a multiple of k")).cast("boolean"))
        sizes = sizes.filter(even)
    rows = df.select(batch, key, F.coalesce(F.col(length), F.lit(0)).cast("long").alias(length))
    placed = with_place(rows, [batch], number_order(rows, length, tie=key)).join(sizes, F.col(batch).eqNullSafe(F.col("__batch")))
    placed = placed.withColumn("__lane", F.col("__place") % F.col("parts")).withColumn("__group", F.floor(F.col("__lane") / F.col("__wide")))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        wide, group = int(pdf["__wide"].iloc[0]), int(pdf["__group"].iloc[0])
        k = min(wide, int(pdf["parts"].iloc[0]) - group * wide)
        part = pd.Series(0, index=pdf.index)
        for p, at in enumerate(karmarkar_karp(pdf[length].tolist(), k, equal)):
            part[at] = p + group * wide
        return pdf[[batch, key, length]].assign(part=part, parts=pdf["parts"])

    kinds = dict(rows.dtypes)
    balanced = placed.filter("__wide > 1").groupBy(batch, "__group").applyInPandas(split, f"{batch} {kinds[batch]}, {key} {kinds[key]}, {length} long, part long, parts long")
    return balanced.unionByName(placed.filter("__wide = 1").select(batch, key, length, F.col("__lane").alias("part"), "parts"))


def balanced_partition(df: DataFrame, batch: str, key: str, length: str, k: int, equal: bool = False, room: int = 4096) -> DataFrame:
    """batch, key, part: the rows of each batch in k parts of about the same sum (equal: and of the same number of rows)."""
    return _parted(df, batch, key, length, F.lit(k), equal, room).select(batch, key, "part")


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most: int, room: int = 4096) -> DataFrame:
    """batch, key, part, parts: each batch cut into as few micro-batches as hold `most` tokens on average (but no more than it has
    rows), of about the same sum. No task holds more than about `room` rows of a batch."""
    parts = F.least(F.greatest(F.ceil(F.col("__sum") / most), F.lit(1)), F.col("__n"))
    return _parted(df, batch, key, length, parts, False, room).select(batch, key, "part", "parts")


def model_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Full batches of `size` rows in hash order; what is left over goes."""
    full = df.count() // size
    told = with_place(df, [], md5_order(key)).withColumn("batch", F.floor(F.col("__place") / size))
    return told.filter(F.col("batch") < full).drop("__place")
