"""What finds information for an agent's queries, chosen by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import prompts as pr
from quern.sources.indexes import Postings
from quern.sources.service import retrieved
from quern.sources.vector_index import Index

Retriever = Callable[[DataFrame], DataFrame]


def _told(hits: DataFrame) -> DataFrame:
    """id, information of hits (query_id, rank, contents): documents by rank as passages; queries that find nothing have none."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "contents"))), lambda x: x["contents"])
    return hits.filter("contents IS NOT NULL").groupBy(F.col("query_id").alias("id")).agg(pr.passages(listed).alias("information"))


def _bm25(path: str, corpus: DataFrame, topk: int) -> Retriever:
    index = Postings(corpus.sparkSession, path)

    def find(queries: DataFrame) -> DataFrame:
        hits = index.search(queries.select(F.col("id").alias("query_id"), F.col("query").alias("text")), topk)
        return _told(hits.join(corpus.select("doc_id", "contents"), "doc_id"))

    return find


def _dense(path: str, corpus: DataFrame, topk: int, encode: Callable[[Column], Column], probes: int | None = None) -> Retriever:
    index = Index(corpus.sparkSession, path)

    def find(queries: DataFrame) -> DataFrame:
        hits = index.search(queries.select(F.col("id").alias("query_id"), encode(F.col("query")).alias("v")), topk, probes)
        return _told(hits.join(corpus.select("doc_id", "contents"), "doc_id"))

    return find


def _service(url: str, topk: int, **how) -> Retriever:
    def find(queries: DataFrame) -> DataFrame:
        return _told(retrieved(queries.select(F.col("id").alias("query_id"), "query"), url, topk, **how))

    return find


KINDS: dict[str, Callable[..., Retriever]] = {"bm25": _bm25, "dense": _dense, "service": _service}


def retriever(kind: str, **options) -> Retriever:
    """(id, query) -> (id, information) by the name of the kind.

    bm25: path (written postings), corpus (doc_id, contents), topk. dense: path (a written vector index), corpus, topk, encode (a
    column of queries to one of vectors), probes. service: url, topk and what a client of the service takes. Further kinds are added
    to KINDS."""
    if kind not in KINDS:
        raise ValueError(f"no retriever {kind!r}; there are {', '.join(sorted(KINDS))}")
    return KINDS[kind](**options)
