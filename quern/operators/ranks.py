"""Places and running sums over whole tables or large groups, without a task that holds them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MOST = 65535


def md5_order(key: str, seed: int = 42) -> tuple[Column, list[Column]]:
    """(bucket, order) of a hash of a key: the same on every engine."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), [h, F.col(key)]


def cell(x: Column, edges: Column, through: bool = False) -> Column:
    """How many of ascending edges are below x (through: below or equal), by halving."""
    step = lambda at, s: F.when(F.get(edges, at + s - 1) <= x if through else F.get(edges, at + s - 1) < x, at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(11))]), F.lit(0), step)


def numbers(values: list[float]) -> Column:
    """An array of constants, as one of them to the planner."""
    told = ", ".join("NaN" if v != v else "-Infinity" if v == -math.inf else "Infinity" if v == math.inf else repr(v) for v in values)
    return F.expr(f"from_json('[{told}]', 'array<double>')")


def number_order(df: DataFrame, column: str, ascending: bool = True, tie: str | None = None, cuts: int = 1000) -> tuple[Column, list[Column]]:
    """(bucket, order) of a number of df; nulls come first (last if not ascending). Cells lie between quantiles of the column, so
    they hold about as many rows each however its values are spread, and are cut in 64 buckets of equal width. Rows of one value
    share a bucket unless tie, a second column, is given: a value that fills several cells is then dealt to them by a hash of tie,
    which comes next in the order."""
    x = F.col(column).cast("double")
    shares = numbers([k / cuts for k in range(cuts + 1)])
    found = df.agg(F.percentile_approx(x, shares, 20_000).alias("q")).first()["q"] or [0.0]
    edges = numbers(found)
    at = cell(x, edges)
    low, high = F.get(edges, at - 1), F.get(edges, at)
    part = F.coalesce(F.least(F.floor(64 * F.try_divide(x - low, high - low)), F.lit(63)), F.lit(0))
    order = [F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()]
    bucket = at * 64 + part
    if tie is not None:
        h = F.pmod(F.xxhash64(tie), F.lit(1 << 20))
        wide = cell(x, edges, through=True) - at + 1
        step = F.floor(h * wide / (1 << 20)) if ascending else wide - 1 - F.floor(h * wide / (1 << 20))
        bucket = F.when(step > 0, (at + step) * 64).otherwise(bucket)
        order += [h, F.col(tie)]
    bucket = F.when(x.isNull(), 0).otherwise(bucket).cast("int")
    return (bucket if ascending else _MOST - bucket), order


def before(df: DataFrame, keys: list[str], by: tuple[Column, list[Column]], **values: Column) -> DataFrame:
    """df with a column for each of values: its sum over the rows of the same keys that stand before the row.

    by: a bucket in [0, 65535] that never falls along the order, and the order. Sums of buckets and of groups of 256 of them are
    made first, so a task holds a bucket's rows, or 256 sums, and never a whole group. Null keys are a group."""
    bucket, order = by
    name = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])) if keys else F.lit("")
    told = df.withColumns({f"__{n}": v for n, v in values.items()}).withColumn("__k", name).withColumn("__b", bucket).withColumn("__g", F.shiftright("__b", 8))

    def earlier(column: str, w) -> Column:
        return F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = told.groupBy("__k", "__g", "__b").agg(*[F.sum(f"__{n}").alias(f"__s_{n}") for n in values])
    inner = sums.select("__k", "__g", "__b", *[earlier(f"__s_{n}", Window.partitionBy("__k", "__g").orderBy("__b")).alias(f"__i_{n}") for n in values])
    outer = sums.groupBy("__k", "__g").agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in values])
    outer = outer.select("__k", "__g", *[earlier(f"__s_{n}", Window.partitionBy("__k").orderBy("__g")).alias(f"__o_{n}") for n in values])
    starts = inner.join(outer, ["__k", "__g"]).select("__k", "__b", *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(f"__a_{n}") for n in values])
    rows = told.join(starts, ["__k", "__b"])
    here = Window.partitionBy("__k", "__b").orderBy(*order)
    own = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return rows.select(*own, *[(F.col(f"__a_{n}") + earlier(f"__{n}", here)).alias(n) for n in values])


def with_place(df: DataFrame, keys: list[str], by: tuple[Column, list[Column]], name: str = "__place") -> DataFrame:
    """df with its place (from 0) in the order, among the rows of the same keys."""
    return before(df, keys, by, **{name: F.lit(1).cast("long")})


#: Rows that one task puts in order without a second thought.
FEW = 1 << 20


def below(df: DataFrame, keys: list[str], column: str, ascending: bool = True, **values: Column) -> DataFrame:
    """`before` in the order of a number that is unique among the rows of the same keys. df: a written table, which is counted first:
    a window alone will do for a table of up to FEW rows."""
    if df.count() > FEW:
        return before(df, keys, number_order(df, column, ascending), **values)
    order = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in values.items()})
