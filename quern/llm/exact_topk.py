"""Exact top-k search by block-at-a-time pruning.

Vectors are put in an order in which like ones stand together and cut into blocks, ranges of that order. A block keeps
its vectors (the forward index) and, for each component (term), the largest and smallest value in it. For a query
the sum over terms of its value times the block's maximum (minimum where the query is negative) bounds each score in the
block. Blocks are scored from the highest bound down until the bound is below the k-th score so far; ties are still
looked at. A query first searches the part it stands in itself. The other parts' own maxima and minima are a small table:
a query goes only to parts whose bound reaches its k-th score, which it takes along. All numbers are whole, so no rounding
moves a bound: doubles where they hold all sums exactly, else Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import with_row_id, written

#: Stands for a null id, which so comes last among ties.
_NULL = (1 << 63) - 1


@dataclass(frozen=True)
class Search:
    """k: hits of a query. block: vectors in a block. part: vectors in a part, which one task holds. queries: in a task.
    told: parts whose bounds are sent to every executor at once."""

    k: int = 5
    block: int = 256
    part: int = 8192
    queries: int = 4096
    told: int = 2048


class Hits:
    """The best (score, id) of each query so far; ties to the smaller id. kind: float, or object for Python integers."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None, kind: type = float) -> None:
        self.k = k
        self.score = np.full((n, k), -np.inf, dtype=kind)
        self.id = np.full((n, k), _NULL, dtype=np.int64)
        self.least = np.full(n, -np.inf, dtype=kind) if least is None else least.astype(kind)  # a score that k others are known to reach

    def floor(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the block's vectors, -inf where a vector is out. ids ascend."""
        hope = ((scores >= self.floor()[rows, None]) & (scores > -np.inf)).astype(bool)
        some = hope.any(axis=1)
        rows, scores = rows[some], np.where(hope[some], scores[some], -np.inf)
        if not len(rows):
            return
        if self.score.dtype == object:
            for r, row in zip(rows.tolist(), scores, strict=True):
                best = sorted([*zip(self.score[r], self.id[r].tolist(), strict=True), *zip(row, ids.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[: self.k]
                self.score[r], self.id[r] = [x for x, _ in best], [i for _, i in best]
            return
        top = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        s = np.concatenate([self.score[rows], np.take_along_axis(scores, top, axis=1)], axis=1)
        i = np.concatenate([self.id[rows], ids[top]], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


@dataclass
class Block:
    rows: np.ndarray
    ids: np.ndarray
    values: np.ndarray
    high: np.ndarray
    low: np.ndarray


def _kind(*values: np.ndarray) -> type:
    """float where inner products of rows of these stay exact in doubles, else object, for Python integers."""
    largest = max(float(np.abs(v.astype(float)).max(initial=0.0)) for v in values)
    return float if max(v.shape[-1] for v in values) * largest * largest < 2.0**52 else object


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score where components lie between low and high."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def search(blocks: list[Block], rows: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> Hits:
    """Hits of queries (their row ids and vectors) among blocks, without their own rows."""
    if not blocks or not len(queries):
        return Hits(len(queries), k, least)
    width = max(queries.shape[1], *(b.values.shape[1] for b in blocks))
    high, low = (np.concatenate([_wide(x[None], width) for x in xs]) for xs in ([b.high for b in blocks], [b.low for b in blocks]))
    kind = _kind(queries, high, low)
    hits = Hits(len(queries), k, least, kind)
    q = _wide(queries, width).astype(kind)
    bounds = _bounds(q, high.astype(kind), low.astype(kind))
    order = np.argsort(-bounds, axis=1, kind="stable")
    for turn in range(len(blocks)):  # in each turn every query that isn't done looks at its next best block
        now = order[:, turn]
        open_ = np.flatnonzero(np.take_along_axis(bounds, now[:, None], axis=1)[:, 0] >= hits.floor())
        if not len(open_):
            break
        for b in np.unique(now[open_]):
            mine, block = open_[now[open_] == b], blocks[b]
            scores = q[mine] @ _wide(block.values, width).astype(kind).T
            scores[rows[mine][:, None] == block.rows[None, :]] = -np.inf
            hits.add(mine, scores, block.ids)
    return hits


def _matrix(column) -> np.ndarray:
    """Rows of lists, shorter ones filled with zeros."""
    lists = [np.asarray(x, dtype=np.int64) for x in column]
    out = np.zeros((len(lists), max(map(len, lists), default=0)), dtype=np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _blocks(pdf: pd.DataFrame) -> list[Block]:
    out = []
    for r in pdf.itertuples():
        values = np.frombuffer(r.values_, dtype=np.int64).reshape(-1, r.width)
        out.append(Block(np.frombuffer(r.rows, dtype=np.int64), np.frombuffer(r.ids, dtype=np.int64), values, values.max(axis=0), values.min(axis=0)))
    return out


def _found(pdf: pd.DataFrame, hits: Hits) -> pd.DataFrame:
    at, place = np.nonzero((hits.score > -np.inf).astype(bool))
    ids = [None if x == _NULL else x for x in hits.id[at, place].tolist()]
    return pd.DataFrame({"row": pdf["row"].to_numpy()[at], "query_id": pdf["id"].to_numpy()[at], "vec_id": pd.array(ids, dtype="Int64"), "score": [int(x) for x in hits.score[at, place]]})


_FOUND = "row long, query_id long, vec_id long, score long"


def _least(column: pd.Series) -> np.ndarray:
    """Whole numbers, none as -inf."""
    return np.array([-np.inf if x is None or x != x else int(x) for x in column], dtype=object)


def integer_vectors(df: DataFrame, vector: str, id: str, scale: int = 256) -> DataFrame:  # noqa: A002
    """id and v, each component x as floor(scale * x). Vectors that are null or hold null, NaN or infinite components are left out."""
    x = F.col(f"`{vector}`")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    told = df.filter(x.isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return told.select(F.col(f"`{id}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def surviving(asked: DataFrame, blocks: DataFrame, p: Search) -> DataFrame:
    """asked (row, id, v, part, least) once for each other part whose bound reaches least, with that part. Bounds are sent to the queries
    `told` parts at a time."""

    def most(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = _blocks(pdf)
        width = max(len(b.high) for b in blocks)
        high, low = np.concatenate([_wide(b.high[None], width) for b in blocks]).max(axis=0), np.concatenate([_wide(b.low[None], width) for b in blocks]).min(axis=0)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "high": [high.tolist()], "low": [low.tolist()]})

    bounds = written(blocks.groupBy("part").applyInPandas(most, "part int, high array<long>, low array<long>"))
    last = bounds.agg(F.max("part")).first()[0]
    out = None
    for at in range(0, (last or 0) + 1, p.told):
        told = bounds.filter(F.col("part").between(at, at + p.told - 1)).collect()  # `told` rows at most
        parts, highs, lows = np.array([r["part"] for r in told], dtype=np.int64), _matrix([r["high"] for r in told]), _matrix([r["low"] for r in told])

        def look(batches: Iterator[pa.RecordBatch], parts=parts, highs=highs, lows=lows) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                    q, least = _matrix(batch.column("v").to_pylist()), _least(batch.column("least").to_pylist())
                    width = max(q.shape[1], highs.shape[1])
                    kind = _kind(q, highs, lows)
                    bound = _bounds(*(_wide(x, width).astype(kind) for x in (q, highs, lows)))
                    ok = (bound >= least.astype(kind)[:, None]).astype(bool) & (parts[None, :] != batch.column("part").to_numpy()[:, None])
                    who, where = np.nonzero(ok)
                    told = batch.drop_columns(["part"]).take(pa.array(who))
                    yield told.append_column("part", pa.array(parts[where].astype(np.int32)))

        goes = asked.mapInArrow(look, "row long, id long, v array<long>, least string, part int")
        out = goes if out is None else out.unionByName(goes)
    return out


def exact_topk(df: DataFrame, vector: str = "embedding", id: str = "vec_id", every: int = 50, params: Search | None = None) -> DataFrame:  # noqa: A002
    """query_id, rank (int, from 1), vec_id, score (long) of the k best rows of each row whose id is divisible by every.

    Each row but the query's own is a candidate; ties go to the smaller id, null ids last. Vectors of different
    length are filled with zeros. A row repeated is a candidate (and a query) of its own. Fewer hits where there are
    fewer rows; an empty table gives an empty one. Other columns are not read.
    """
    p = params or Search()
    vectors = written(with_row_id(integer_vectors(df, vector, id), "row"))
    n = vectors.count()
    like = [F.expr("array_position(v, array_max(v))"), F.expr("array_position(v, array_min(v))"), "row"]
    parts = max(1, -(-n // p.part))
    ordered = vectors.repartitionByRange(parts, *like).sortWithinPartitions(*like).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            held.sort(key=lambda r: _NULL if r[1] is None else r[1])
            values = _matrix([r[2] for r in held])
            if not values.shape[1]:
                values = np.zeros((len(held), 1), dtype=np.int64)
            ids = np.array([_NULL if r[1] is None else r[1] for r in held], dtype=np.int64)
            row = [[held[0][3]], [np.array([r[0] for r in held], dtype=np.int64).tobytes()], [ids.tobytes()], [values.tobytes()], [values.shape[1]]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["part", "rows", "ids", "values_", "width"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "v", "part")), strict=True):
                held.append(row)
                if len(held) == p.block:
                    yield block()
                    held = []
        if held:
            yield block()

    placed = written(ordered.select("row", "id", "v", "part"))
    blocks = written(placed.mapInArrow(cut, "part int, rows binary, ids binary, values_ binary, width int"))
    queries = placed.filter(F.col("id") % every == 0)
    k = p.k

    def at_home(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=["row", "query_id", "vec_id", "score"])
        return _found(asked, search(_blocks(found), asked["row"].to_numpy(), _matrix(asked["v"]), k))

    home = written(blocks.groupBy("part").cogroup(queries.groupBy("part")).applyInPandas(at_home, _FOUND))
    least = home.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asked = written(queries.join(least, "row", "left").withColumn("least", F.col("least").cast("string")))
    goes = written(surviving(asked, blocks, p))
    sizes = written(goes.groupBy("part").agg(F.ceil(F.count("*") / p.queries).cast("int").alias("groups")))
    dealt = blocks.join(sizes, "part").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    sent = goes.join(sizes.withColumnRenamed("groups", "of"), "part").withColumn("group", F.pmod(F.xxhash64("row"), F.col("of")).cast("int")).drop("of")

    def elsewhere(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame(columns=["row", "query_id", "vec_id", "score"])
        return _found(asked, search(_blocks(found), asked["row"].to_numpy(), _matrix(asked["v"]), k, _least(asked["least"])))

    away = dealt.groupBy("part", "group").cogroup(sent.groupBy("part", "group")).applyInPandas(elsewhere, _FOUND)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return home.unionByName(away).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
