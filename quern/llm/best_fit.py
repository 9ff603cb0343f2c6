"""Best-fit packing of documents into windows under conflicts.

Documents are cut into pieces of at most one window and dealt evenly to independent groups. In a group the longest
piece goes first. Bins are kept in the order of what they have left, each with a bitmap of the duplicate clusters and
bitmaps of the sources it holds; from the tightest bin that has room the search goes on to the next one up until one is
compatible, and only then a new bin is opened. Copies of a text so never share a window, and no source fills one with
more than its allowed documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORD, written


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a window. per_source: documents of one source in a window at most. group: pieces in a group, about."""

    capacity: int = 2048
    per_source: int = 4
    group: int = 2048


def pack(lengths: list[int], clusters: list, sources: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each piece, lengths up to capacity; longest first, ties in the order given.

    A cluster with one piece and a source with at most per_source pieces can't conflict and get no bit."""
    bits = {c: 1 << k for k, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    planes = {s: k for k, s in enumerate(s for s, n in Counter(sources).items() if n > per_source)}
    free: list[tuple[int, int]] = []  # (left, bin), ordered
    cluster_map: list[int] = []
    source_map: list[int] = []  # per_source bits a source: the n-th is set with its n-th piece
    filled: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bit, full = bits.get(clusters[i], 0), 0
        if (plane := planes.get(sources[i])) is not None:
            full = 1 << (plane * per_source + per_source - 1)
        at = bisect_left(free, (lengths[i], -1))
        while at < len(free) and (cluster_map[free[at][1]] & bit or source_map[free[at][1]] & full):
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(filled)
            cluster_map.append(0)
            source_map.append(0)
            filled.append(0)
        out[i] = (b, filled[b])
        filled[b] += 1
        cluster_map[b] |= bit
        if plane is not None:
            lowest = 1 << (plane * per_source)
            while source_map[b] & lowest:
                lowest <<= 1
            source_map[b] |= lowest
        if left > lengths[i]:
            insort(free, (left - lengths[i], b))
    return out


def best_fit(df: DataFrame, text: str = "text", source: str = "source", cluster: Column | None = None, tokens: Column | None = None, along: Column | None = None, params: Packing | None = None) -> DataFrame:
    """A row a piece: the columns of df except the text, and piece (from 0), start, length (tokens of the document),
    pack_group, bin, place (in the window), all long; (pack_group, bin) tells windows apart.

    tokens: of a document; by default its words and one end. cluster: documents with equal values never share a
    window; by default those with equal texts. Null texts are empty: one token. Null sources are a source. A document
    longer than a window fills whole windows and packs the rest. Pieces of one document may not share a window either.
    Repeated rows are copies of each other; an empty table gives an empty one. Columns of df with these names are replaced;
    none may be a map. along: a document's place in an order, from 0 to under 1; groups are then stretches of that order, of about as
    many documents each, and pieces of a document stay together (null: at the start); by default a hash deals pieces. Ties in length go by a hash of the row. The result does not depend on the order of the rows.
    """
    p = params or Packing()
    made = ("piece", "start", "length", "pack_group", "bin", "place")
    own = [c for c in df.columns if c not in (*made, text)]
    t = F.coalesce(F.col(text), F.lit(""))
    size = (F.regexp_count(t, F.lit(WORD)) + 1 if tokens is None else F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1))).cast("long")
    told = df.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), F.coalesce((F.xxhash64(t) if cluster is None else F.xxhash64(cluster)), F.lit(0)).alias("cluster"),
        (F.lit(None).cast("double") if along is None else F.coalesce(along.cast("double"), F.lit(0.0))).alias("along"),
    )
    # Rows alike are counted and numbered, so where a row goes depends on the rows alone and not on how files are split.
    told = told.groupBy("own", "source", "size", "cluster", "along").agg(F.count("*").alias("times"))
    told = written(told)  # without texts
    pieces = told.agg(F.coalesce(F.sum(F.col("times") * F.ceil(F.col("size") / p.capacity)), F.lit(0))).first()[0]
    groups = max(1, -(-pieces // p.group))
    told = told.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).drop("times")
    told = told.withColumn("deal", F.xxhash64("own", "cluster", "copy"))
    cut = told.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / p.capacity))))
    cut = cut.withColumn("start", F.col("piece") * p.capacity).withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(p.capacity)))
    dealt = F.pmod(F.xxhash64("deal", "piece"), F.lit(groups)) if along is None else F.least(F.floor(F.col("along") * groups), F.lit(groups - 1))
    cut = cut.withColumn("pack_group", dealt.cast("long"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", "size", "piece"], kind="stable", ignore_index=True)
        where = pack(pdf["length"].tolist(), pdf["cluster"].tolist(), pdf["source"].tolist(), p.capacity, p.per_source)
        return pdf.assign(bin=[b for b, _ in where], place=[k for _, k in where])[["own", "piece", "start", "length", "pack_group", "bin", "place"]]

    kinds = ", ".join(f"{c} bigint" for c in made)
    out = cut.groupBy("pack_group").applyInPandas(packed, f"own {told.schema['own'].dataType.simpleString()}, {kinds}")
    return out.select(*[F.col(f"own.`{c}`").alias(c) for c in own], *made)
