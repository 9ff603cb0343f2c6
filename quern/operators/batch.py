"""A batch as a table: checked column merges, repeats, chunks, folds, reordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import number_order, with_place
from quern.sources.shared import kept


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both for the same rows. Columns that both have have to be equal: a row in which they are not raises an error."""
    both = [c for c in b.columns if c in a.columns and c != key]
    right = b.withColumnsRenamed({c: f"__{c}" for c in both})
    joined = a.join(right, key)
    if both:  # a filter, so that the check stays whatever columns are asked for
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in both])
        joined = joined.filter(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("columns differ at "), F.col(key).cast("string"))).cast("boolean")))
    return joined.drop(*[f"__{c}" for c in both])


def repeated(df: DataFrame, n: int, name: str = "copy") -> DataFrame:
    """Each row n times, its copies numbered from 0; ordered by row they interleave, ordered by copy they tile."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def chunks(df: DataFrame, order: str, n: int, name: str = "chunk") -> DataFrame:
    """n chunks of consecutive rows in the order of a unique number, as even as can be, numbered from 0; the first ones take what is over."""
    size, over = divmod(df.count(), n)
    place = F.col("__place")
    chunk = F.when(place < over * (size + 1), F.floor(place / (size + 1))).otherwise(over + F.floor((place - over * (size + 1)) / max(size, 1)))
    return with_place(df, [], number_order(df, order)).withColumn(name, chunk.cast("int")).drop("__place")


def folded(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(value))


def unfolded(df: DataFrame, value: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != value], F.posexplode(value).alias("pos", value))


def reordered(df: DataFrame, permutation: DataFrame, key: str) -> DataFrame:
    """Rows with the place that a permutation (key, place) gives them."""
    return df.join(permutation, key)


def greedy_clusters(pairs: DataFrame, group: str, n: str) -> DataFrame:
    """group, item, cluster. pairs: group, n (items of the group, 0 .. n - 1), same (array of structs (a, b) of equivalent items, a < b).

    In the order of items, one without a cluster opens the next and takes all later items that are equivalent to it, also those
    that have a cluster already. A fold over the items of a group, of which there are a few."""
    start = F.struct(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.lit(-1)).alias("c"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        free = F.get(state["c"], i) == -1
        joined = F.transform(state["c"], lambda c, j: F.when(free & ((j == i) | F.exists("same", lambda p: (p["a"] == i) & (p["b"] == j))), state["k"]).otherwise(c))
        return F.struct(joined.alias("c"), (state["k"] + free.cast("int")).alias("k"))

    out = F.aggregate(F.sequence(F.lit(0), F.col(n) - 1), start, step, lambda s: s["c"])
    return pairs.select(group, F.posexplode(out).alias("item", "cluster"))


def greedy_groups(items: DataFrame, same: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, cluster of greedy_clusters, for groups of any size. items: group, item (a number, unique in its group); same:
    group, a, b (items that are equivalent, a < b; repeated rows say nothing more).

    An item opens a cluster if no earlier one that does is equivalent to it, and any other belongs to the last one before it that
    is. So clusters are opened in rounds over the table of pairs: items whose earlier neighbours have all been decided against open
    one, their later neighbours don't, and the pairs of both are done with. Rounds end with the longest chain of such decisions:
    a few for pairs in no order, half an item each where every item is like the next alone."""
    pairs = kept(same.select(F.col(group).alias("g"), "a", "b").filter("a < b").distinct(), "pairs")
    left, taken = pairs, []
    while not left.isEmpty():
        opens = left.select("g", F.col("a").alias("o")).distinct().join(left.select("g", F.col("b").alias("o")).distinct(), ["g", "o"], "left_anti")
        gone = kept(left.join(opens.withColumnRenamed("o", "a"), ["g", "a"]).select("g", F.col("b").alias("o")).distinct(), "taken")
        taken.append(gone)
        left = kept(left.join(gone.withColumnRenamed("o", "b"), ["g", "b"], "left_anti").join(gone.withColumnRenamed("o", "a"), ["g", "a"], "left_anti"), "pairs")
    every = items.select(F.col(group).alias("g"), F.col(item).alias("o"))
    lost = reduce(DataFrame.unionByName, taken) if taken else every.limit(0)
    first = kept(every.join(lost, ["g", "o"], "left_anti"), "openers")
    openers = with_place(first, ["g"], number_order(first, "o"), "cluster").select("g", "o", F.col("cluster").cast("int").alias("cluster"))
    by = pairs.join(first.withColumnRenamed("o", "a"), ["g", "a"]).groupBy("g", F.col("b").alias("i")).agg(F.max("a").alias("o"))
    joined = by.join(first.withColumnRenamed("o", "i"), ["g", "i"], "left_anti").join(openers, ["g", "o"]).select("g", "i", "cluster")
    return openers.select("g", F.col("o").alias("i"), "cluster").unionByName(joined).select(F.col("g").alias(group), F.col("i").alias(item), "cluster")


def last_token_reward(tokens: DataFrame, keys: list[str], pos: str, mask: str, score: Column | str, name: str = "reward") -> DataFrame:
    """tokens with the score of their row on its last valid token (the largest pos of mask 1), 0 on the others; a row without a
    valid token has it nowhere."""
    last = tokens.filter(F.col(mask) == 1).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(pos).alias("__last"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    value = F.col(score) if isinstance(score, str) else score
    return tokens.join(last, on, "left").withColumn(name, F.when(F.col(pos) == F.col("__last"), value.cast("double")).otherwise(0.0)).drop("__last", *[f"__{k}" for k in keys])


def first_containing(rows: DataFrame, order: str, text: str, mark: str) -> DataFrame:
    """Position (from 0) of the first row, in the order, whose text holds the mark; null if none does."""
    hit = rows.filter(F.contains(F.col(text), F.lit(mark))).agg(F.min(order).alias("o"))
    return rows.filter(F.col(order) < hit.scalar()).agg(F.when(hit.scalar().isNotNull(), F.count("*")).alias("position"))


def flops(df: DataFrame, length: str, layers: int, hidden: int, parameters: int) -> DataFrame:
    """Floating-point operations of a training step: 6 per parameter and token, and attention's share in the squared lengths."""
    s = F.col(length).cast("double")
    return df.agg((6 * F.lit(float(parameters)) * F.sum(s) + 12 * layers * hidden * F.sum(s * s)).alias("flops"))


def masked_concat(prompt: Column, prompt_masked: Column, response: Column, info: Column | None, pad: int, left: bool = True) -> Column:
    """(ids, ids with the information masked) of prompt, response and information behind each other: information is pads in the
    second, so that a loss leaves it out. Both are put in the order that brings the pads of the first to the left (or right) and keeps
    the others as they stand."""
    more = info if info is not None else F.array().cast("array<int>")
    ids = F.concat(prompt, response, more)
    masked = F.concat(prompt_masked, response, F.transform(more, lambda _: F.lit(pad)))
    both = F.arrays_zip(ids.alias("a"), masked.alias("b"))
    pads, others = F.filter(both, lambda x: x["a"] == pad), F.filter(both, lambda x: x["a"] != pad)
    out = F.concat(pads, others) if left else F.concat(others, pads)
    return F.struct(F.transform(out, lambda x: x["a"]).alias("ids"), F.transform(out, lambda x: x["b"]).alias("masked"))


def cut_to_effective(df: DataFrame, ids: str, mask: str, left: bool = True) -> DataFrame:
    """Arrays cut to the longest row's number of ones in mask: the last so many (or, unless left, the first)."""
    most = df.select(F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    cut = (lambda c: F.slice(c, F.greatest(F.size(c) - most, F.lit(0)) + 1, F.lit(most))) if left else (lambda c: F.slice(c, 1, most))
    return df.withColumns({ids: cut(F.col(ids)), mask: cut(F.col(mask))})


def timing_per_token(lengths: DataFrame, prompt: str, response: str, seconds: dict[str, float]) -> DataFrame:
    """section, timing_s and ms a token: generation over response tokens, all other sections over all tokens."""
    sums = lengths.agg(F.sum(prompt).alias("p"), F.sum(response).alias("r"))
    told = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(float(v)).alias("timing_s")) for k, v in seconds.items()])
    each = sums.select("p", "r", F.inline(told))
    tokens = F.when(F.col("section") == "gen", F.col("r")).otherwise(F.col("p") + F.col("r"))
    return each.select("section", "timing_s", F.try_divide(F.col("timing_s") * 1000, tokens).alias("ms_per_token"))
