"""A client of a retrieval service: POST {queries, topk, return_scores}, answered by a list of documents for each query."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def post(url: str, body: dict, tries: int = 3, timeout: float = 60.0, pause: float = 1.0) -> dict:
    """The answer to a request; tried again after errors of the network and the server, with growing pauses."""
    for k in range(tries):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as error:
            if k + 1 == tries or isinstance(error, urllib.error.HTTPError) and error.code < 500:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("tries has to be 1 at least")


HIT = "rank int, doc_id string, title string, text string, contents string, score double, error string"


def answered(url: str, queries: list[tuple], topk: int, told: bool, **how) -> Iterator[tuple]:
    """(query_id, rank, doc_id, title, text, contents, score, error) of queries (query_id, query) by one request. told: a request
    that fails for good is a row with the error for each of its queries, else it is raised."""
    try:
        result = post(url, {"queries": [q for _, q in queries], "topk": topk, "return_scores": True}, **how)["result"]
    except (urllib.error.URLError, TimeoutError, json.JSONDecodeError, KeyError) as error:
        if not told:
            raise
        yield from ((query, None, None, None, None, None, None, f"{type(error).__name__}: {error}") for query, _ in queries)
        return
    for (query, _), hits in zip(queries, result, strict=True):
        for rank, hit in enumerate(hits, 1):
            d = hit["document"]
            yield query, rank, str(d.get("id", "")), d.get("title"), d.get("text"), d.get("contents"), hit.get("score"), None


def retrieved(queries: DataFrame, url: str, topk: int, batch: int = 64, errors: str = "fail", at_once: int | None = None, **how) -> DataFrame:
    """query_id, rank, doc_id, title, text, contents, score for queries (query_id, query); `batch` queries a request.

    errors: fail ends the job when a request has failed its last try; column keeps going and gives the queries of that request a row
    with `error`. at_once: no more than so many requests at a time, whatever the cluster has cores."""
    if errors not in ("fail", "column"):
        raise ValueError("errors is fail or column")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = answered(url, list(zip(part["query_id"].tolist(), part["query"].tolist(), strict=True)), topk, errors == "column", **how)
                out = pd.DataFrame(rows, columns=["query_id", "rank", "doc_id", "title", "text", "contents", "score", "error"])
                yield out.astype({"rank": "Int32", "score": "float64"})

    kind = dict(queries.dtypes)["query_id"]
    some = queries.select("query_id", "query")
    out = (some.repartition(at_once) if at_once else some).mapInPandas(ask, f"query_id {kind}, {HIT}")
    return out if errors == "column" else out.drop("error")
