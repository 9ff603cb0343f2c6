"""Scores of predictions: confusion, ranking curves, rollups, entropies, outlier trimming, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import below
from quern.sources.shared import kept


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1; 0 where a ratio has no denominator."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return n.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_threshold(df: DataFrame, truth: str, score: str) -> DataFrame:
    """A row a distinct score, with positives and negatives: the only rows that a curve needs in order."""
    return df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))


def auroc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the receiver curve by mid-ranks; 0 where a class is missing."""
    steps = kept(_by_threshold(df, truth, score), "thresholds")
    steps = below(steps, [], "s", below=F.col("n")).withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2))
    return steps.agg(F.coalesce(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n").cast("double")), F.lit(0.0)).alias("auroc"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Sum over distinct thresholds of the step in recall times precision; 0 where a class is missing."""
    steps = kept(_by_threshold(df, truth, score), "thresholds")
    steps = below(steps, [], "s", ascending=False, ps=F.col("p"), ns=F.col("n"))
    p, n = F.col("ps") + F.col("p"), F.col("ns") + F.col("n")
    steps = steps.withColumn("ap", F.col("p") * p / (p + n))
    return steps.agg(F.when(F.sum("n") > 0, F.coalesce(F.try_divide(F.sum("ap"), F.sum("p")), F.lit(0.0))).otherwise(0.0).alias("auprc"))


def rollup_accuracy(df: DataFrame, source: str, correct: Column, em: Column) -> DataFrame:
    """Accuracy and exact match per source and overall (source 'all')."""
    told = df.select(F.col(source).alias("source"), correct.cast("double").alias("c"), em.cast("double").alias("e"))
    rolled = told.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), F.avg("c").alias("accuracy"), F.avg("e").alias("em"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "accuracy", "em")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], count: str | None = None) -> DataFrame:
    """keys and a column for each share: the exact percentile, between neighbouring ranks by the line through them.

    Rows of a value are counted first; counts before a value come from sums by buckets (of few values from a window), and only the
    values that hold the ranks are read. No task holds the rows of a group. Nulls are no values; a group without any gives nulls. count: how often a row counts."""
    n = F.count("__x") if count is None else F.sum(F.when(F.col("__x").isNotNull(), F.col(count)).otherwise(0))
    counts = kept(df.withColumn("__x", F.col(value)).groupBy(*keys, "__x").agg(n.alias("__n")), "counts")
    told = below(counts, keys, "__x", __below=F.col("__n"))
    sizes = counts.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(F.sum("__n").alias("__all"))
    on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys] or [F.lit(True)]
    told = told.join(sizes, reduce(lambda a, b: a & b, on))
    here = lambda rank: F.max(F.when((F.col("__n") > 0) & (F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__n")), F.col("__x")))
    out = []
    for name, share in shares.items():
        rank = share * (F.col("__all") - 1)
        low, high = here(F.floor(rank)), here(F.ceil(rank))
        at = F.first(rank)
        out.append(F.when(F.first(F.floor(rank)) == F.first(F.ceil(rank)), low).otherwise((F.first(F.ceil(rank)) - at) * low + (at - F.first(F.floor(rank))) * high).alias(name))
    return told.groupBy(*keys).agg(*out)


def length_stats(df: DataFrame, source: str, length: Column) -> DataFrame:
    """n, total, mean and p50/p90/p95/p99 (interpolated) per source and overall."""
    told = df.select(F.col(source).alias("source"), length.cast("double").alias("x"))
    rolled = told.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean"))
    # values are counted once; all of them together are a group beside the sources
    counts = told.groupBy("source", "x").agg(F.count("*").alias("c"))
    both = counts.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).select("g", F.when(F.col("g") == 0, F.col("source")).alias("source"), "x", "c")
    shares = {f"p{p}": p / 100 for p in (50, 90, 95, 99)}
    at = percentiles(both, ["g", "source"], "x", shares, count="c").select(F.col("g").alias("__g"), F.col("source").alias("__s"), *shares)
    joined = rolled.join(at, (F.col("g") == F.col("__g")) & F.col("source").eqNullSafe(F.col("__s")))
    return joined.select(F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "total", "mean", *shares)


def histogram(df: DataFrame, score: str, equal: list[float], least: list[float]) -> DataFrame:
    """Shares of scores equal to, or at least, given values."""
    share = lambda c, name: F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name)
    name = lambda x: str(x).replace(".", "_").replace("-", "m")
    return df.agg(*[share(F.col(score) == x, f"eq_{name(x)}") for x in equal], *[share(F.col(score) >= x, f"ge_{name(x)}") for x in least])


def pass_at_k(df: DataFrame, question: str, score: str) -> DataFrame:
    """Share of questions whose best score is 1."""
    best = df.groupBy(question).agg(F.max(score).alias("m"))
    return best.agg(F.avg((F.col("m") == 1).cast("double")).alias("pass_at_k"), F.count("*").alias("questions"))


def best_per_metric(df: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """metric, model, value of the best model (ties by name)."""
    long = df.unpivot(model, metrics, "metric", "value")
    order = F.struct(F.col("value"), F.col(model))
    return long.groupBy("metric").agg(F.max_by(model, order).alias("model"), F.max("value").alias("value"))


def log_mean_exp(df: DataFrame, group: str, cluster: str, ll: str) -> DataFrame:
    """Per cluster, the log of its share of the group's likelihood; stable, as the group's maximum is taken out first."""
    top = df.withColumn("__m", F.max(ll).over(Window.partitionBy(group)))
    mass = top.groupBy(group, cluster).agg(F.sum(F.exp(F.col(ll) - F.col("__m"))).alias("m"))
    return mass.select(group, cluster, F.log(F.col("m") / F.sum("m").over(Window.partitionBy(group))).alias("log_share"))


def entropies(df: DataFrame, group: str, cluster: str, ll: str) -> DataFrame:
    """Monte-Carlo entropy of the log-likelihoods, Rao's over cluster shares, and that of cluster sizes."""
    mc = df.groupBy(group).agg((-F.avg(ll)).alias("mc"), F.count("*").alias("n"))
    p = F.exp("log_share")
    rao = log_mean_exp(df, group, cluster, ll).groupBy(group).agg((-F.sum(p * F.col("log_share"))).alias("rao"))
    sizes = df.groupBy(group, cluster).agg(F.count("*").alias("__n")).withColumn("s", F.col("__n") / F.sum("__n").over(Window.partitionBy(group)))
    assigned = sizes.groupBy(group).agg((-F.sum(F.col("s") * F.log("s"))).alias("assigned"))
    return mc.join(rao, group).join(assigned, group)


def trimmed_mean(df: DataFrame, group: str, value: str, rounds: int = 5, width: float = 2.0, least: int = 3) -> DataFrame:
    """Mean after up to `rounds` rounds that drop values beyond width * IQR of the positional quartiles s[n/4], s[3n/4].

    A round leaves a group of fewer than `least` values alone. Groups are folded as arrays, bounded by the runs of a question."""
    s = F.sort_array(F.collect_list(value))

    def step(a: Column) -> Column:
        n = F.size(a)
        q1, q3 = F.get(a, F.floor(n / 4).cast("int")), F.get(a, F.floor(3 * n / 4).cast("int"))
        low, high = q1 - width * (q3 - q1), q3 + width * (q3 - q1)
        return F.when(n < least, a).otherwise(F.filter(a, lambda x: (x >= low) & (x <= high)))

    told = df.groupBy(group).agg(s.alias("s"))
    for _ in range(rounds):
        told = told.withColumn("s", step(F.col("s")))
    return told.select(group, (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")).alias("mean"), F.size("s").alias("kept"))


def answer_perplexity(df: DataFrame, run: str, lp: str) -> DataFrame:
    """exp(-mean log-probability), 1 where a run has none."""
    return df.groupBy(run).agg(F.coalesce(F.exp(-F.avg(lp)), F.lit(1.0)).alias("perplexity"))


def semantic_perplexity(pairs: DataFrame, question: str, likelihood: str, agree: str, ours: str) -> DataFrame:
    """Soft and hard semantic perplexity of given agreement scores: what share of the likelihood says our answer."""
    soft = F.sum(F.col(likelihood) * F.col(agree)) / F.sum(likelihood)
    hard = F.sum(F.when(F.col(ours) == 1, F.col(likelihood)).otherwise(0.0)) / F.sum(likelihood)
    return pairs.groupBy(question).agg(soft.alias("soft"), hard.alias("hard"))
