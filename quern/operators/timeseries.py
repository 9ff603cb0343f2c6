"""Hourly series of (entity, item): binning, filling, normalising, describing. Long form throughout; nothing is densified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_hour(df: DataFrame, origin: str, ts: str = "ts", name: str = "hour") -> DataFrame:
    """Hours since origin, rounded down (also before it)."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lit(origin).cast("timestamp"))
    return df.withColumn(name, F.floor(seconds / 3600).cast("int"))


def hourly(df: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """Mean of the valid values of an hour; hours without any give none."""
    v = F.col(value) if isinstance(value, str) else value
    return df.filter(v.isNotNull()).groupBy(*keys, "hour").agg(F.avg(v).alias("value"))


def hourly_first(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, "hour").agg(F.min_by(value, F.struct(*order)).alias("value"))


def hourly_last(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last valid write of an hour wins."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, "hour").agg(F.max_by(value, F.struct(*order)).alias("value"))


def locf(grid: DataFrame, keys: list[str], value: str = "value", order: str = "hour") -> DataFrame:
    """Last observation carried forward over a grid; a leading gap is 0."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(0.0)))


def dense_grid(series: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """A row for each key and hour below `hours`; value is null where the series has none."""
    grid = series.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return grid.join(series, [*keys, "hour"], "left")


def capped_grid(series: DataFrame, entity: str, keys: list[str], most: int = 48) -> DataFrame:
    """A row for each key and hour from 0 up to its entity's last hour, `most` hours at most; value is null where the series has none."""
    last = series.groupBy(entity).agg(F.least(F.max("hour") + 1, F.lit(most)).alias("__h")).filter("__h > 0")
    grid = series.select(*keys).distinct().join(last, entity).withColumn("hour", F.explode(F.sequence(F.lit(0), F.col("__h") - 1))).drop("__h")
    return grid.join(series, [*keys, "hour"], "left")


def padded(values: Column, least: int = 3) -> Column:
    """An array of `least` values at least: its last one is said again. An empty one stays."""
    more = F.greatest(F.lit(least) - F.size(values), F.lit(0))
    return F.when(F.size(values) > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), more))).otherwise(values)


def series_stats(series: DataFrame, keys: list[str], value: str = "value", hours: int = 48) -> DataFrame:
    """Mean, population deviation, extremes, median and the share of hours that have a value."""
    v = F.col(value)
    return series.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.lit(0.5)).alias("median"), (F.count(v) / hours).alias("availability")
    )


def minmax(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """To [0, 1] within a series; a constant one to 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return series.withColumn(value, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def shift_negative(series: DataFrame, keys: list[str], hour: str = "hour") -> DataFrame:
    """Hours start at 0 where a series starts before it; others stay."""
    return series.withColumn(hour, F.col(hour) - F.least(F.min(hour).over(Window.partitionBy(*keys)), F.lit(0)))


def last_k(series: DataFrame, keys: list[str], k: int, order: str = "hour") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return series.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def density(series: DataFrame, entity: str, item: str, hours: int) -> DataFrame:
    """Per entity, filled cells over all cells of its item x hour grid."""
    return series.groupBy(entity).agg((F.count("value") / (F.countDistinct(item) * hours)).alias("density"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value, ties to the smallest."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def temporal_text(series: DataFrame, keys: list[str], value: Column, base: int = 1, word: str = "at") -> DataFrame:
    """One line a series, 'v at hour h' in the order of hours, counted from base."""
    step = F.struct("hour", F.concat(value.cast("string"), F.lit(f" {word} hour "), (F.col("hour") + base).cast("string")).alias("t"))
    parts = F.transform(F.sort_array(F.collect_list(step)), lambda x: x["t"])
    return series.groupBy(*keys).agg(F.array_join(parts, ", ").alias("text"))


def parse_temporal(text: Column, word: str = "at") -> Column:
    """The numbers of a temporal line, others left out."""
    return F.filter(F.transform(F.split(text, ", "), lambda x: F.split_part(x, F.lit(f" {word} hour"), F.lit(1)).try_cast("double")), lambda v: v.isNotNull())


def ordinal(text: Column, scale: dict[str, float], exact: bool = False) -> Column:
    """Words of a scale as numbers; trimmed and without regard to case unless exact. Unknown words are null."""
    key = text if exact else F.lower(F.trim(text))
    table = F.create_map(*[F.lit(x) for k, v in scale.items() for x in (k if exact else k.lower(), float(v))])
    return table[key]


def flags(means: DataFrame, rules: list[tuple[str, str, str, float]], item: str, entity: str) -> DataFrame:
    """entity and its flags (item, name, op, bound) that the mean of an item raises, as a sorted text."""
    cases = [F.when((F.col(item) == i) & (F.col("mean") > b if op == ">" else F.col("mean") < b), F.lit(name)) for i, name, op, b in rules]
    told = means.select(entity, F.array_compact(F.array(*cases)).alias("f"))
    return told.groupBy(entity).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))), ",").alias("flags"))


def indicator_summary(series: DataFrame, keys: list[str], value: str, bounds: dict[str, tuple[float | None, float | None]] | None = None, item: str | None = None) -> DataFrame:
    """keys, n, min, max, mean, mode, low, high: what is said of an indicator. mode: the value met most often, of equally frequent
    ones the smallest; low, high: whether some value is under or over the bounds of the item. Nulls are no values. Values are
    counted first, so no task holds the rows of a series."""
    counts = series.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    told = counts.groupBy(*keys).agg(
        F.sum("__n").alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"), (F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")).alias("mean"), F.max_by("__v", F.struct("__n", -F.col("__v"))).alias("mode")
    )
    under, over = F.lit(False), F.lit(False)
    for name, (low, high) in (bounds or {}).items():
        here = F.col(item) == name
        under = under | (here & (F.col("min") < low)) if low is not None else under
        over = over | (here & (F.col("max") > high)) if high is not None else over
    return told.withColumns({"low": under, "high": over})
