"""Batch math of policy optimisation over (uid, row, pos) in long form, or over arrays of one row."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_ids(df: DataFrame, keys: list[str], pos: str, mask: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("position", (F.sum(mask).over(w) - 1) * F.col(mask))


def eos_mask(df: DataFrame, keys: list[str], pos: str, is_eos: Column) -> DataFrame:
    """1 up to the first end token and on it."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    e = is_eos.cast("int")
    return df.withColumn("eos_mask", ((F.sum(e).over(w) - e) == 0).cast("int"))


def gae(df: DataFrame, keys: list[str], pos: str, reward: str, value: str, gamma: float, lam: float, chunk: int = 512) -> DataFrame:
    """keys, pos, advantage, ret: a = delta + gamma lam a(next), delta = r + gamma v(next) - v, nothing behind the last step.

    The recurrence is linear, so a chunk of steps is a pair (factor, offset). Chunks are summed side by side, from the right;
    their pairs, one a chunk, are put together in a fold; then each step adds its share of what comes behind its chunk. A task
    holds a chunk's steps, or a sequence's pairs. Steps are unique numbers; null rewards and values are 0."""
    c = gamma * lam
    size = chunk if c in (0.0, 1.0) else max(1, min(chunk, int(200 / abs(math.log10(abs(c))))))  # c ** size stays a number
    told = df.select(*keys, F.col(pos).cast("long").alias("__p"), F.coalesce(F.col(reward).cast("double"), F.lit(0.0)).alias("__r"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"))
    told = told.withColumn("__c", F.floor(F.col("__p") / size))
    names = [f"__k{n}" for n in range(len(keys))]
    kinds = [f"{n} {dict(df.dtypes)[k]}" for n, k in zip(names, keys, strict=True)]

    def from_right(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each chunk of a sequence: the value and the advantage of the step behind it."""
        pdf = pdf.sort_values("__c", ascending=False, ignore_index=True)
        v, a, behind = 0.0, 0.0, []
        for n, r, first, last, offset in zip(pdf["__n"], pdf["__f"], pdf["__first"], pdf["__last"], pdf["__o"], strict=True):
            behind.append((v, a))
            # the offset was made with nothing behind the chunk: its last step sees v, and all of them a
            a = offset + r / c * gamma * v + r * a if c else offset + (gamma * v if n == 1 else 0.0)
            v = first
        return pdf[[*names, "__c"]].assign(__nv=[x[0] for x in behind], __na=[x[1] for x in behind])

    w = Window.partitionBy(*keys, "__c").orderBy(F.desc("__p"))
    k = F.row_number().over(w)
    steps = told.withColumn("__i", k).withColumn("__d", F.col("__r") + gamma * F.coalesce(F.lag("__v").over(w), F.lit(0.0)) - F.col("__v"))
    if c:
        local = F.pow(F.lit(c), "__i") * F.sum(F.col("__d") * F.pow(F.lit(1 / c), "__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        local = F.col("__d")
    steps = steps.withColumn("__a", local)
    pairs = steps.groupBy(*[F.col(x).alias(n) for x, n in zip(keys, names, strict=True)], "__c").agg(
        F.count("*").alias("__n"), F.pow(F.lit(c), F.count("*")).alias("__f"), F.min_by("__v", "__p").alias("__first"), F.max_by("__v", "__p").alias("__last"), F.min_by("__a", "__p").alias("__o")
    )
    more = pairs.withColumn("__chunks", F.count("*").over(Window.partitionBy(*names))).filter("__chunks > 1")  # others have nothing behind
    behind = more.groupBy(*names).applyInPandas(from_right, ", ".join(kinds) + ", __c long, __nv double, __na double")
    on = [F.col(x).eqNullSafe(F.col(n)) for x, n in zip(keys, names, strict=True)]
    joined = steps.withColumnRenamed("__c", "__d_c").join(behind, reduce(lambda x, y: x & y, [*on, F.col("__d_c") == F.col("__c")]), "left").fillna(0.0, ["__nv", "__na"])
    # c ** i of what is behind, and gamma v(next) of the chunk's last step, which c ** (i - 1) brings here
    rest = F.pow(F.lit(c), "__i") * F.col("__na") + (F.pow(F.lit(c), F.col("__i") - 1) if c else (F.col("__i") == 1).cast("double")) * gamma * F.col("__nv")
    return joined.withColumn("__a", F.col("__a") + rest).select(*keys, F.col("__p").alias(pos), F.col("__a").alias("advantage"), (F.col("__a") + F.col("__v")).alias("ret"))


def whiten(df: DataFrame, value: str, mask: str, name: str) -> DataFrame:
    """(x - mean) / sqrt(variance + 1e-8) with the mask's mean and sample variance, read once as scalars."""
    m = df.filter(F.col(mask) == 1).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return df.withColumn(name, (F.col(value) - m.select("m").scalar()) / F.sqrt(m.select("v").scalar() + 1e-8))


def masked_stats(df: DataFrame, value: str, mask: str) -> DataFrame:
    x = F.when(F.col(mask) == 1, F.col(value))
    return df.agg(F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def group_norm(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """Relative to the group: (x - mean) / (sample deviation + eps); alone in a group x stays, over 1 + eps."""
    w = Window.partitionBy(group)
    n, mean, std = F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)
    return df.withColumn("advantage", F.when(n == 1, F.col(score) / (1 + eps)).otherwise((F.col(score) - mean) / (std + eps)))


def kl(lp: Column, ref: Column, kind: str) -> Column:
    d = lp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    return F.greatest(F.least(F.exp(-d) + d - 1, F.lit(10.0)), F.lit(-10.0))  # low variance


def adaptive_coefficient(coefficient: float, current: float, target: float, steps: int, horizon: int) -> float:
    """Driver state: moved towards the target KL by at most a fifth of the error."""
    return coefficient * (1 + max(min(current / target - 1, 0.2), -0.2) * steps / horizon)


def ppo_loss(df: DataFrame, mask: str, old: str, new: str, advantage: str, clip: float = 0.2) -> DataFrame:
    """Clipped policy loss, clipped share and approximate KL over the mask."""
    ratio = F.exp(F.col(new) - F.col(old))
    a, b = -F.col(advantage) * ratio, -F.col(advantage) * F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip))
    return df.filter(F.col(mask) == 1).agg(F.avg(F.greatest(a, b)).alias("loss"), F.avg((b > a).cast("double")).alias("clipfrac"), F.avg(F.col(old) - F.col(new)).alias("approx_kl"))


def value_loss(df: DataFrame, mask: str, value: str, old: str, ret: str, clip: float = 0.5) -> DataFrame:
    v = F.greatest(F.least(F.col(value), F.col(old) + clip), F.col(old) - clip)
    a, b = F.pow(F.col(value) - F.col(ret), 2), F.pow(v - F.col(ret), 2)
    return df.filter(F.col(mask) == 1).agg((0.5 * F.avg(F.greatest(a, b))).alias("value_loss"), F.avg((b > a).cast("double")).alias("value_clipfrac"))


def logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def entropy(x: Column) -> Column:
    """Of the softmax: logsumexp - sum p x."""
    z = logsumexp(x)
    return z - F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - z) * v)


def chosen_logprob(x: Column, label: Column) -> Column:
    return F.element_at(x, label) - logsumexp(x)


def pads_left(ids: Column, pad: int) -> Column:
    """Stable: pads first, the others behind them."""
    return F.concat(F.filter(ids, lambda x: x == pad), F.filter(ids, lambda x: x != pad))


def fixed_length(ids: Column, n: int, pad: int, left: bool = False) -> Column:
    """Cut or padded to n, on the left or right."""
    size = F.size(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - size, F.lit(0)))
    return F.concat(fill, F.slice(ids, F.greatest(size - n, F.lit(0)) + 1, F.lit(n))) if left else F.concat(F.slice(ids, 1, n), fill)


def effective(ids: Column, n: Column) -> Column:
    """The last n of an array padded on the left."""
    return F.slice(ids, F.size(ids) - n + 1, n)


def tempered(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda x: x / temperature)


def clamped(x: Column, low: Column, high: Column) -> Column:
    """Value by value between the values of two other arrays."""
    return F.zip_with(F.zip_with(x, high, lambda a, b: F.least(a, b)), low, lambda a, b: F.greatest(a, b))
