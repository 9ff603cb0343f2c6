"""Stored indexes: postings and vectors as Parquet, written once and searched often."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval as rt
from quern.sources.shared import kept


def write_postings(corpus: DataFrame, path: str, docs: int = 128, parts: int = 64, k1: float = 0.9, b: float = 0.4) -> None:
    """BM25 postings of a corpus (doc_id, text): path/postings (term, block, n, top, docs) and path/size (n, avgdl).

    Documents are dealt into blocks of about `docs` by a hash of their ids. A row holds a term's documents in a block with what the
    term adds to each, before its weight, how many they are and the largest of these. Texts are shuffled once, by block; all counts
    of a block are made, and written, where it lies. Each of `parts` files holds blocks of its own, sorted by term, so a search
    reads row groups of its terms, and a term of all documents is in all files."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    corpus.select(F.size(words).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/size")
    told = corpus.sparkSession.read.parquet(f"{path}/size").first()
    blocks = max(1, -(-told["n"] // docs))
    rows = corpus.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "text").repartition(parts, "block")  # texts are smaller than their words
    each = rows.select("block", "doc_id", words.alias("w")).select("block", "doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    counts = each.groupBy("block", "doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    added = counts.select("block", "doc_id", "term", rt.bm25_part(F.col("tf"), F.col("dl"), told["avgdl"], k1, b).alias("part"))
    listed = added.groupBy("block", "term").agg(F.count("*").alias("n"), F.max("part").alias("top"), F.sort_array(F.collect_list(F.struct("doc_id", "part"))).alias("docs"))
    listed.sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")


class Postings:
    """Written postings, open for searching."""

    def __init__(self, spark: SparkSession, path: str, most_terms: int = 10_000) -> None:
        self.spark, self.most_terms = spark, most_terms
        self.size = spark.read.parquet(f"{path}/size").first()
        self.table = spark.read.parquet(f"{path}/postings")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, weight; rows of the index with these terms). Up to most_terms terms are a filter that reaches the
        files; more are joined."""
        words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
        asked = queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        terms = asked.select("term").distinct()
        some = [r[0] for r in terms.limit(self.most_terms + 1).collect()]
        mine = self.table.filter(F.col("term").isin(some)) if len(some) <= self.most_terms else self.table.join(terms, "term", "left_semi")
        df, n = mine.groupBy("term").agg(F.sum("n").alias("df")), self.size["n"]
        weight = F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(df, "term").select("query_id", "term", weight.alias("weight")), mine

    def _scored(self, pairs: DataFrame, asked: DataFrame, mine: DataFrame) -> DataFrame:
        """Scores of all documents of pairs (query_id, block)."""
        told = pairs.select("query_id", "block").join(asked, "query_id").join(mine.select("term", "block", "docs"), ["term", "block"])
        each = told.select("query_id", "weight", F.inline("docs"))
        return each.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score"))

    def plan(self, queries: DataFrame, k: int, first: int = 4) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
        """(rows of the `first` blocks of highest bound of each query, the other (query_id, block, bound) whose bound reaches the
        k-th score of these, what scores the documents of such pairs). For bounds no list of documents is read."""
        asked, mine = self._asked(queries)
        asked = kept(asked, "asked")
        bound = F.sum(F.col("weight") * F.col("top")).alias("bound")
        bounds = kept(mine.select("term", "block", "top").join(asked, "term").groupBy("query_id", "block").agg(bound), "bounds")
        seeds = rt.best(bounds, "query_id", "bound", "block", first).select("query_id", "block")
        home = kept(rt.best(self._scored(seeds, asked, mine), "query_id", "score", "doc_id", k), "home")
        floor = home.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = bounds.join(floor, "query_id", "left").filter("floor IS NULL OR bound >= floor - 1e-6").join(seeds, ["query_id", "block"], "left_anti")
        return home, rest, lambda pairs: self._scored(pairs, asked, mine)

    def search(self, queries: DataFrame, k: int, first: int = 4) -> DataFrame:
        """query_id, rank, doc_id, score: the k best documents by BM25, ties to the smaller doc_id. Queries: query_id, text."""
        home, rest, scored = self.plan(queries, k, first)
        return rt.best(home.drop("rank").unionByName(scored(rest)), "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int, most_terms: int = 10_000) -> DataFrame:
    return Postings(spark, path, most_terms).search(queries, k)


def write_vectors(vectors: DataFrame, path: str, rows: int = 10_000, normalised: bool = True) -> None:
    """A store of vectors (doc_id, v), files of `rows` rows, to unit length unless told otherwise."""
    v = rt.unit(F.col("v")) if normalised else F.col("v")
    vectors.select("doc_id", v.alias("v")).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """Exact top k of queries (query_id, v) in a store of vectors."""
    return rt.dense_topk(spark.read.parquet(path), queries.select("query_id", rt.unit(F.col("v")).alias("v")), k)


def write_batch(df: DataFrame, meta: dict, path: str) -> None:
    """A batch with what is known of it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = spark.read.schema("meta string").json(f"{path}/meta").first()["meta"]
    return spark.read.parquet(f"{path}/rows"), json.loads(meta)
