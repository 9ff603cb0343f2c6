"""Cohorts and histories: enrichment, ordered lookups, prior events, first and last per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quern.operators.ranks import cell


def renamed(df: DataFrame, names: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns renamed by a map; those that are missing come from defaults."""
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return out.withColumns({k: v for k, v in (defaults or {}).items() if k not in out.columns})


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows not in done: resumption and removals."""
    return df.join(done, on, "left_anti")


def enrich(df: DataFrame, *sides: tuple[DataFrame, str | list[str]]) -> DataFrame:
    """Left joins with dimensions, one after the other."""
    return reduce(lambda a, side: a.join(side[0], side[1], "left"), sides, df)


def fallback_lookup(df: DataFrame, key: str, formats: list[Column], table: DataFrame, code: str, value: str, name: str) -> DataFrame:
    """The value of the first format of the key that the table knows, by one join: formats are tried in their order."""
    tried = df.withColumn("__c", F.transform(F.array(*formats), lambda c, k: F.struct(k.alias("k"), c.alias("c"))))
    each = tried.select(key, F.explode("__c").alias("x")).distinct().join(table.select(F.col(code).alias("__code"), F.col(value).alias("__v")), F.col("x.c") == F.col("__code"))
    best = each.groupBy(key).agg(F.min_by("__v", "x.k").alias(name))
    return df.join(best, key, "left")


def priors(df: DataFrame, entity: str, time: str, event: str) -> DataFrame:
    """event, prior: all strictly earlier events of the same entity."""
    a, b = df.select(entity, F.col(event), F.col(time).alias("__t")), df.select(entity, F.col(event).alias("prior"), F.col(time).alias("__p"))
    return a.join(b, entity).filter("__p < __t").select(event, "prior", F.col("__p").alias("prior_time"))


def latest_priors(df: DataFrame, entity: str, time: str, event: str, k: int) -> DataFrame:
    """event, place, prior: the k latest strictly earlier events, ties to the larger id."""
    order = Window.partitionBy(entity).orderBy(time, event)
    seen = df.select(entity, event, time, F.row_number().over(order).alias("__n"), F.rank().over(Window.partitionBy(entity).orderBy(time)).alias("__r"))
    wanted = seen.select(entity, event, F.col("__r"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place")).withColumn("__n", F.col("__r") - F.col("place")).filter("__n >= 1")
    return wanted.join(seen.select(entity, "__n", F.col(event).alias("prior")), [entity, "__n"]).select(event, "place", "prior")


def first_after(anchors: DataFrame, events: DataFrame, entity: str, start: str, time: str, item: str, anchor: str, value: str, order: str, target: int = 1 << 20) -> DataFrame:
    """anchor, item, value of the first event of each item at or after the anchor's time; of equal times the smallest order.

    Anchors and events of an entity and item are one stream, latest first, in which an anchor sees the event last met. The stream
    of an entity of over `target` events is cut at quantiles of its times: pieces run side by side, and the first events of pieces
    are carried to the ones before them. Null times and entities match nothing."""
    at = lambda c: F.col(c).cast("double") if isinstance(events.schema[time].dataType, NumericType) else F.col(c).cast("timestamp").cast("double")
    told = events.filter(F.col(time).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("e"), F.col(item).alias("i"), at(time).alias("t"), F.col(order).alias("o"), F.struct(F.col(value).alias("value")).alias("v"))
    asked = anchors.filter(F.col(start).isNotNull()).select(F.col(entity).alias("e"), at(start).alias("t"), F.col(anchor).alias("anchor"))
    hot = [r["e"] for r in told.groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") > target).select("e").limit(4097).collect()]
    piece = lambda df: df.withColumn("piece", F.lit(0))
    if hot:
        busy = told if len(hot) > 4096 else told.filter(F.col("e").isin(hot))
        edges = busy.groupBy("e").agg(F.array_distinct(F.percentile_approx("t", [k / 256 for k in range(1, 256)], 20_000)).alias("edges"))
        cut = F.coalesce(cell(F.col("t"), F.col("edges")), F.lit(0))
        piece = lambda df: df.join(edges if len(hot) > 4096 else F.broadcast(edges), "e", "left").withColumn("piece", cut).drop("edges")
    told, asked = piece(told), piece(asked)
    items = told.select("e", "i").distinct()
    rows = told.withColumn("anchor", F.lit(None).cast(asked.schema["anchor"].dataType)).unionByName(asked.join(items, "e").withColumns({"o": F.lit(None).cast(told.schema["o"].dataType), "v": F.lit(None).cast(told.schema["v"].dataType)}))
    here = Window.partitionBy("e", "piece", "i").orderBy(F.desc("t"), F.col("v").isNull(), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("here", F.last("v", ignorenulls=True).over(here))
    out = seen.filter("v IS NULL").select("e", "i", "piece", "anchor", "here")
    if hot:
        firsts = rows.groupBy("e", "i", "piece").agg(F.min(F.when(F.col("v").isNotNull(), F.struct("t", "o", "v")))["v"].alias("first"))
        later = Window.partitionBy("e", "i").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
        out = out.join(firsts.withColumn("carry", F.last("first", ignorenulls=True).over(later)), ["e", "i", "piece"]).withColumn("here", F.coalesce("here", "carry"))
    return out.filter("here IS NOT NULL").select(F.col("anchor").alias(anchor), F.col("i").alias(item), F.col("here.value").alias("value"))


def nth(df: DataFrame, entity: str, order: list[str], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


def ordered_list(df: DataFrame, key: str, seq: str, value: str, default: int = 999, first: int | None = None) -> DataFrame:
    """key, list of value by seq (default where null), the first ones only if asked; the lead is the one with seq 1."""
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(seq), F.lit(default)).alias("s"), F.col(value).alias("v"))))
    items = F.transform(pairs, lambda x: x["v"])
    return df.groupBy(key).agg((F.slice(items, 1, first) if first else items).alias("items"), F.min(F.when(F.col(seq) == 1, F.col(value))).alias("lead"))


def stats_of_counts(df: DataFrame, entity: str, item: str) -> DataFrame:
    """Items per entity over the population."""
    n = df.groupBy(entity).agg(F.countDistinct(item).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), F.percentile("n", F.lit(0.5)).alias("median"))
