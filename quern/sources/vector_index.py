"""A stored vector index that prunes: vectors in lists around centres, a folder a list, searched by inner product.

A search reads the lists nearest to a query, or, if it has to be exact, first the nearest ones and then each list whose bound
(query times centre, plus the query's length times the list's radius) still reaches the query's k-th score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval as rt
from quern.sources.shared import kept

#: Numbers in all centres together: what driver and tasks hold of an index (128 MB).
MOST_CENTRES = 1 << 24


def lists_of(kind: str, rows: int) -> int:
    """Lists that a factory string asks for: Flat has one, IVF<n>,Flat has n. A graph (HNSW<m>) has no counterpart among tables:
    it stands for an approximate index, here one of sqrt(rows) lists."""
    if kind == "Flat":
        return 1
    if found := re.fullmatch(r"IVF(\d+)(,Flat)?", kind):
        return int(found[1])
    if re.fullmatch(r"HNSW\d+(,Flat)?", kind):
        return max(1, round(rows**0.5))
    raise ValueError(f"index type {kind!r} is none of Flat, IVF<n>,Flat, HNSW<m>")


def _centres(vectors: DataFrame, lists: int, rows: int, sample: int, seed: int) -> np.ndarray:
    """Centres by k-means over at most about `sample` rows, taken by a hash of their ids."""
    some = vectors
    if rows > sample:
        some = vectors.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(sample / rows * (1 << 30)))
    if lists == 1:
        return np.array([some.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("x")).orderBy("pos").toPandas()["x"].to_numpy()])
    model = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(some.select(array_to_vector("v").alias("features")))
    return np.stack(model.clusterCenters())


def write_index(vectors: DataFrame, path: str, kind: str = "Flat", normalised: bool = True, sample: int = 65_536, seed: int = 42, files: int = 8) -> None:
    """Index of vectors (doc_id, v) under path: lists/list=<n> and centres (list, centre, n, radius).

    Centres are fitted on about `sample` rows, every row is in a list. Rows whose vector is null are left out; vectors get unit
    length unless told otherwise. A list is written in up to `files` files by a hash of ids, so a list with a third of all rows
    is no single task's."""
    spark = vectors.sparkSession
    v = rt.unit(F.col("v")) if normalised else F.transform("v", lambda x: x.cast("double"))
    told = vectors.filter("v IS NOT NULL").select("doc_id", v.alias("v"))
    rows = told.count()
    if not rows:
        raise ValueError("an index needs a vector")
    centres = _centres(told, min(lists_of(kind, rows), rows), rows, sample, seed)
    if centres.size > MOST_CENTRES:
        raise ValueError(f"{len(centres)} centres of {centres.shape[1]} numbers are more than an executor holds")
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<list:int,away:double>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = sent.value
        half = (c * c).sum(axis=1) / 2
        for batch in batches:
            x = np.stack(batch.to_list())
            at = np.argmax(x @ c.T - half, axis=1)
            yield pd.DataFrame({"list": at.astype(np.int32), "away": np.sqrt(((x - c[at]) ** 2).sum(axis=1))})

    placed = told.withColumn("__at", nearest("v")).select("doc_id", "v", F.col("__at.away").alias("away"), F.col("__at.list").alias("list"))
    placed.repartition("list", F.pmod(F.xxhash64("doc_id"), F.lit(files))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    sizes = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>")
    table.join(sizes, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


class Index:
    """A written index, open for searching."""

    def __init__(self, spark: SparkSession, path: str, normalised: bool = True, block: int = rt.BLOCK) -> None:
        told = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()
        self.spark, self.path, self.normalised, self.block = spark, path, normalised, block
        self.lists, self.sizes = told["list"].to_numpy(), told["n"].to_numpy()
        self.told = spark.sparkContext.broadcast((self.lists, np.stack(told["centre"].to_list()), told["radius"].to_numpy()))

    def _near(self, queries: DataFrame, first: int | None, slack: float = 0.0) -> DataFrame:
        """queries with `lists`: the `first` nearest ones, or (of queries with a floor) those beyond it that may reach the floor."""
        told = self.told

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lists, centres, radius = told.value
            for batch in batches:
                if not len(batch):
                    continue
                q = np.stack(batch["v"].to_list()).astype(float)
                score = q @ centres.T
                order = np.argsort(-score, axis=1, kind="stable")
                if "floor" in batch:
                    bound = score + np.linalg.norm(q, axis=1)[:, None] * radius * (1 + 1e-12) + slack
                    reach = bound >= batch["floor"].to_numpy()[:, None]
                    np.put_along_axis(reach, order[:, :first], False, axis=1)
                    at = [np.flatnonzero(x) for x in reach]
                else:
                    at = order[:, :first]
                yield batch[["query_id", "v"]].assign(lists=[lists[x].tolist() for x in at])

        return queries.mapInPandas(look, f"query_id {dict(queries.dtypes)['query_id']}, v array<double>, lists array<int>")

    def rows(self, lists: list[int]) -> DataFrame:
        """Rows of some lists alone: their folders are all that is read."""
        return self.spark.read.parquet(f"{self.path}/lists").filter(F.col("list").isin(lists))

    def _scored(self, asked: DataFrame, k: int, digits: int | None) -> DataFrame:
        """The k best rows of each query in its lists. A large list is met in blocks, many queries as well. The table of lists is
        sent to all tasks: it is smaller than the centres, which they have."""
        each = asked.select("query_id", "v", F.explode("lists").alias("list"))
        wanted = [r[0] for r in each.select("list").distinct().collect()]  # no more than there are lists
        cuts = self.spark.createDataFrame([(int(n), -(-int(s) // self.block)) for n, s in zip(self.lists, self.sizes, strict=True)], "list int, cut int")
        parts = max(1, -(-asked.count() // self.block))
        docs = self.rows(wanted).join(F.broadcast(cuts), "list").select("doc_id", "v", "list", F.pmod(F.xxhash64("doc_id"), "cut").cast("int").alias("a"))
        docs = docs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        each = each.join(F.broadcast(cuts), "list").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).drop("cut").withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        kinds = dict(docs.dtypes) | dict(asked.dtypes)
        found = docs.groupBy("list", "a", "b").cogroup(each.groupBy("list", "a", "b"))
        return found.applyInPandas(rt.block_product(k, digits), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")

    def asked(self, queries: DataFrame) -> DataFrame:
        v = rt.unit(F.col("v")) if self.normalised else F.transform("v", lambda x: x.cast("double"))
        return queries.filter("v IS NOT NULL").select("query_id", v.alias("v"))

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, v, lists: where a search of so many probes goes."""
        return self._near(self.asked(queries), probes)

    def reached(self, queries: DataFrame, k: int, first: int = 1, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows found in the `first` nearest lists, query_id, v and the other lists that may hold one of the k best)."""
        asked = self.asked(queries)
        home = kept(rt.best(self._scored(self._near(asked, first), k, digits), "query_id", "score", "doc_id", k), "home")
        floor = home.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        low = asked.join(floor, "query_id", "left").fillna(float("-inf"), ["floor"])
        return home.drop("rank"), kept(self._near(low, first, 1e-9 if digits is None else 10.0**-digits), "rest")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, first: int = 1, digits: int | None = None) -> DataFrame:
        """query_id, rank, doc_id, score of the k best rows, ties to the smaller doc_id: of the `probes` nearest lists, or of all
        (None), where lists that cannot hold one of the k best are not read. Queries without a vector find nothing."""
        if probes is not None:
            found = self._scored(self.probed(queries, probes), k, digits)
        else:
            home, rest = self.reached(queries, k, first, digits)
            found = home.unionByName(self._scored(rest, k, digits))
        return rt.best(found, "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")
