"""Retrieval and similarity: exact dense top-k, BM25, reranking, statistic similarity and time warping of series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import important_ids, tag_bodies

#: Rows of a block of queries or of documents; a pair of blocks is one task's matrix product.
BLOCK = 8192


def unit(v: Column) -> Column:
    """v / |v|, in doubles; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best(df: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank; the limit reaches below the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best_of_rows(scores: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest scores of each row, rounded before they are compared, ties to the smaller column.

    The k-th largest of the maxima of runs of columns is no higher than the k-th score, so only what reaches it is rounded and sorted."""
    rows, n = scores.shape
    width = n // (8 * k)
    if width > 1 and np.isfinite(scores).all():
        runs = scores[:, : n // width * width].reshape(rows, -1, width).max(axis=2)
        low = np.partition(runs, runs.shape[1] - k, axis=1)[:, runs.shape[1] - k]
        low = low - (1e-9 if digits is None else 2 * 10.0**-digits)
        at, column = np.nonzero(scores >= low[:, None])
    else:
        at, column = np.divmod(np.arange(rows * n), max(n, 1))
    score = scores[at, column]
    score = score if digits is None else np.round(score, digits)
    order = np.lexsort((column, -score, at))
    at, column, score = at[order], column[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], column[place < k], score[place < k]


def block_product(k: int, digits: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best rows of a block of documents for each of a block of queries, as a product of two matrices."""

    def product(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        d = d.sort_values("doc_id", ignore_index=True)
        v = np.stack(d["v"].to_list()).astype(float)
        out = []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            scores = np.stack(part["v"].to_list()).astype(float) @ v.T
            at_, column, score = _best_of_rows(scores, k, digits)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[at_], "doc_id": d["doc_id"].to_numpy()[column], "score": score}))
        return pd.concat(out)

    return product


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score by inner product, ties to the smaller doc_id. corpus: doc_id, v; queries: query_id, v, all of one
    length. digits: scores are rounded to so many before they are compared.

    Each block of queries meets each block of documents once, as a product of two matrices, and tells k rows a query."""
    sides = [max(1, -(-df.count() // block)) for df in (corpus, queries)]
    docs = corpus.select("doc_id", "v", F.pmod(F.xxhash64("doc_id"), F.lit(sides[0])).cast("int").alias("a"))
    asked = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(sides[1])).cast("int").alias("b"))
    docs = docs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(sides[1] - 1))))
    asked = asked.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(sides[0] - 1))))
    kinds = dict(docs.dtypes) | dict(asked.dtypes)
    found = docs.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInPandas(block_product(k, digits), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    return best(found, "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def postings(corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """term, doc_id, tf and dl, the words of the document."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    told = corpus.select(F.col(doc).alias("doc_id"), words.alias("w")).select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return told.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_size(postings: DataFrame) -> DataFrame:
    """n (documents with a word) and words of a table of postings."""
    return postings.agg(F.count_distinct("doc_id").alias("n"), F.sum("tf").alias("words"))


def bm25_part(tf: Column, dl: Column, avgdl: float | Column, k1: float, b: float) -> Column:
    """What a term adds to a document's score, before the term's weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_search(postings_: DataFrame, n: Column, avgdl: Column, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """query_id, rank, doc_id, score over a table of postings; queries: query_id, text. Only postings of query terms are read on."""
    asked = postings(queries.select(F.col("query_id").alias("doc_id"), "text"), "doc_id", "text").select("term", F.col("doc_id").alias("query_id"), F.col("tf").alias("qtf"))
    kept = postings_.join(asked.select("term").distinct(), "term", "left_semi")
    df = kept.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = kept.join(df, "term").withColumn("weight", weight).join(asked, "term")
    return best(scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 6).alias("score")), "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """bm25_search over a corpus (doc_id, text) without a stored index."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    size = corpus.select(F.size(words).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return bm25_search(postings(corpus, "doc_id", "text"), F.lit(size["n"]), F.lit(size["avgdl"]), queries, k, k1, b)


def rerank_topk(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best of each query's own candidates by a new score."""
    return best(candidates.drop("rank", "score").withColumn("score", score), "query_id", "score", "doc_id", k)


def similarity(series: DataFrame, entity: str, item: str, value: str) -> DataFrame:
    """a, b, similarity: 1 - (|mean difference| + |deviation difference|) / (2 range), in [0, 1], averaged over shared items."""
    stats = series.groupBy(entity, item).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    spread = series.groupBy(item).agg((F.max(value) - F.min(value)).alias("range"))
    told = stats.join(spread, item)
    left, right = told.select(item, "range", F.col(entity).alias("a"), F.col("m").alias("ma"), F.col("s").alias("sa")), told.select(item, F.col(entity).alias("b"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    raw = 1 - (F.abs(F.col("ma") - F.col("mb")) + F.abs(F.col("sa") - F.col("sb"))) / (2 * F.col("range"))
    one = left.join(right, item).filter("a < b").select("a", "b", F.when(F.col("range") > 0, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))).otherwise(1.0).alias("x"))
    return one.groupBy("a", "b").agg(F.avg("x").alias("similarity"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def warped(a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Dynamic time warping distances of rows of a and b: squared differences, square root of the cheapest path. Rows whose
    distance is over their limit may be given up: infinite.

    Cells are filled by anti-diagonals, all rows at once. A path meets one of any two neighbouring diagonals, so their least
    cell bounds what is left."""
    n, m, rows = a.shape[1], b.shape[1], np.arange(len(a))
    out, most = np.full(len(a), np.inf), None if limit is None else np.where(limit > 0, limit, 0.0) ** 2 * (1 + 1e-9) + 1e-12
    older, old = np.full((len(a), n + 1), np.inf), np.full((len(a), n + 1), np.inf)
    older[:, 0] = 0.0  # before both first cells
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d)
        new = np.full_like(old, np.inf)
        step = np.minimum(np.minimum(old[:, low : high + 1], old[:, low + 1 : high + 2]), older[:, low : high + 1])
        new[:, low + 1 : high + 2] = step + (a[:, low : high + 1] - b[:, d - high : d - low + 1][:, ::-1]) ** 2
        older, old = old, new
        if most is not None and d % 8 == 7:
            stay = np.minimum(old.min(axis=1), older.min(axis=1)) <= most
            if not stay.all():
                a, b, old, older, rows, most = a[stay], b[stay], old[stay], older[stay], rows[stay], most[stay]
    out[rows] = np.sqrt(old[:, n])
    return out if limit is None else np.where(out <= np.where(limit > 0, limit, 0.0) * (1 + 1e-9) + 1e-9, out, np.inf)


def documents_of(text: Column) -> Column:
    """Array of (title, text) of <information> blocks. The first <important_info> between a block and the next names the
    documents it keeps; blocks with a selection come first, then the others whole; of equal texts the first stays."""
    marked = F.slice(F.split(text, "<information>"), F.lit(2), F.size(F.split(text, "<information>")))
    closed = F.filter(marked, lambda s: F.contains(s, F.lit("</information>")))
    head = r'^(\d+) ?\(Title: ?"?(.*?)"?\)'

    def docs(s: Column) -> Column:
        pieces = F.split(F.split_part(s, F.lit("</information>"), F.lit(1)), r"Doc (?=\d+ ?\(Title:)")
        own = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda d: F.regexp_like(d, F.lit(head)))
        return F.transform(own, lambda d: F.struct(F.regexp_extract(d, head, 1).cast("int").alias("n"), F.regexp_extract(d, head, 2).alias("title"), F.trim(F.regexp_replace(d, head, ""), F.lit(" \n")).alias("text")))

    def picked(s: Column) -> Column:
        return F.get(tag_bodies(F.substring_index(s, "</information>", -1), "important_info"), F.lit(0))

    chosen = F.transform(F.filter(closed, lambda s: picked(s).isNotNull()), lambda s: F.filter(docs(s), lambda d: F.array_contains(important_ids(picked(s)), d["n"])))
    rest = F.transform(F.filter(closed, lambda s: picked(s).isNull()), docs)
    kind = "array<struct<title:string,text:string>>"
    flat = F.transform(F.concat(F.flatten(chosen), F.flatten(rest)), lambda d: F.struct(d["title"].alias("title"), d["text"].alias("text")))
    return F.aggregate(flat, F.array().cast(kind), lambda out, d: F.when(F.exists(out, lambda o: o["text"] == d["text"]), out).otherwise(F.array_append(out, d)))
