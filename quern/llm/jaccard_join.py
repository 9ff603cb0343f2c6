"""Exact n-gram Jaccard join of documents as a join in a metric space, giving connected groups.

Jaccard distance of shingle sets is a metric, but unrelated texts all lie at distance 1 from each other, so regions
around pivot *documents* alone would each have to be given nearly all documents. The first pivots therefore are single
shingles. With all shingles in one order, rare ones first, a document is nearest to the pivot of its rarest shingle, and
the window of documents that a linked one may come from reaches to the pivots of its first n - ceil(0.75 n) + 1 shingles:
two linked documents always meet in the region of the first shingle they share, where both still have as many shingles
to come as the link needs. Regions with few documents are joined directly.

A larger region takes a document as its pivot; regions with one pivot are one Voronoi region. It is cut into rings by
distance from the pivot, each with the window of the next one that the triangle inequality allows. Rings are joined
recursively in blocks of bounded size, each pair of blocks in a task of its own. Regions whose documents are in one group
already are done; groups of near copies get there early through a first round of min-wise keys. Of the links measured in a table
of 51,282 documents (4,776) the first round found 36 %, small regions 56 %, pivots 7 % and blocks 1 %; with a very large group
of near copies (10,675) 24, 17, 30 and 28 % (link_steps).

A pair is measured on whole sets only if its sketches allow a link. A sketch has a bit for each of 1,024 cells, the parity
of how many shingles of the set fall into it, so two sets differ in at least as many shingles as their sketches in bits:
no link is lost. A block first tells a forest of possible links between groups, and, once that has been measured, all that
are still possible. Each link that decides a group has been measured, and a pair is passed over only where sizes,
places, the triangle inequality, sketches or a common group rule it out or make it needless. Shingles are known by 64-bit
hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHasher, dropped, mix64, raw_texts, sliced, with_row_id, written

_C = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_CHUNKS = 256
_SKETCH = 1024  # bits


@dataclass(frozen=True)
class Join:
    """Links: 100 * intersection >= percent * union of the sets of `words`-word shingles. cell_bits: size of the table of
    counts that puts shingles in order, at most (24 or less): it follows the input, since with few cells all counts are alike and
    frequent shingles come early; shared_bits: of the table of first shingles that two sets or more have (at least 11);
    mark_bits: of tables that tell which documents are read again (at least 8). They change the speed alone. leaf: documents of a region joined directly. block:
    documents of a block of a larger one. broadcast_rows: a table of so many ids is small enough to be sent to every executor."""

    words: int = 5
    percent: int = 75
    cell_bits: int = 24
    shared_bits: int = 28
    mark_bits: int = 27
    leaf: int = 64
    block: int = 2048
    broadcast_rows: int = 500_000


class Shingler:
    """Sorted distinct shingle hashes of texts (bytes). Texts of fewer words than a shingle have one of all their words."""

    def __init__(self, words: int) -> None:
        self.words, self.hasher = words, WordHasher(lower=True)

    def __call__(self, texts) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(index of the first text, sets) by slices."""
        for at, h, bounds in self.hasher(texts):
            n = len(h) - self.words + 1
            rolled = np.zeros(max(n, 0), dtype=np.uint64)
            for k in range(self.words if n > 0 else 0):
                rolled = rolled * _C + h[k : k + n]
            rolled = mix64(rolled)
            sets = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a >= self.words:
                    sets.append(np.unique(rolled[a : b - self.words + 1]))
                else:
                    sets.append(self._short(h[a:b]))
            yield at, sets

    @staticmethod
    def _short(h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        x = np.full(1, len(h), dtype=np.uint64)
        for k in range(len(h)):
            x = mix64(x) * _C + h[k : k + 1]
        return mix64(x)


def _node(u: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(u.tobytes(), seed=len(u))


def _sketches(every: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Parities of the cells of sets that lie one after the other: uint64 words, a row a set."""
    if not len(lens):
        return np.zeros((0, _SKETCH // 64), dtype=np.uint64)
    cell = (every * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - _SKETCH.bit_length() + 1)).astype(np.int64)
    at = cell + np.repeat(np.arange(len(lens)) * _SKETCH, lens)
    return np.packbits((np.bincount(at, minlength=len(lens) * _SKETCH) & 1).astype(np.uint8)).view(np.uint64).reshape(len(lens), -1)


def _read(docs: DataFrame, p: Join) -> DataFrame:
    """A row a document: id, th (hash of its text), n, node (of its set), keys (two min-wise ones), sketch; and for each task rows of its cells."""
    kinds = pa.schema([("n", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("chunk", pa.int32()), ("cells", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells, schema = Shingler(p.words), np.zeros(1 << p.cell_bits, dtype=np.uint32), None
        for batch in sliced(batches):
            own = batch.select(["id", "th"])
            schema = own.schema
            sizes, nodes, keys, sketches = [], [], [], []
            for _, sets in shingler(raw_texts(batch.column("text"))):
                lens = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                every = np.concatenate(sets)
                np.add.at(cells, every >> np.uint64(64 - p.cell_bits), 1)
                full = np.flatnonzero(lens)
                mine: list = [None] * len(sets)
                if len(full):
                    starts = (np.cumsum(lens) - lens)[full]
                    least = np.stack([np.minimum.reduceat(mix64(every ^ s), starts) for s in _SEEDS], axis=1).view(np.int64)
                    for i, k in zip(full.tolist(), least.tolist(), strict=True):
                        mine[i] = k
                sizes += lens.tolist()
                nodes += map(_node, sets)
                keys += mine
                sketches += [x.tobytes() for x in _sketches(every, lens)]
            n = len(sizes)
            made = [pa.array(x, f.type) for x, f in zip((sizes, nodes, keys, sketches, [None] * n, [None] * n), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], schema=pa.schema([*schema, *kinds]))
        if schema is not None:
            parts = cells.reshape(_CHUNKS, -1)
            told = [k for k in range(_CHUNKS) if parts[k].any()]
            blank = [pa.nulls(len(told), f.type) for f in [*schema, *list(kinds)[:4]]]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(told, pa.int32()), pa.array([_sparse(parts[k]) for k in told], pa.binary())], schema=pa.schema([*schema, *kinds]))

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "th", "text").mapInArrow(read, f"id {kind}, th long, n long, node binary, keys array<long>, sketch binary, chunk int, cells binary")


def _cell_bits(docs: DataFrame, p: Join) -> int:
    """Bits of the order's table: a cell for some 40 bytes of text, few shingles each, as far as cell_bits allows."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(p.cell_bits, max(18, (size >> 5).bit_length() - 1))


def _sparse(counts: np.ndarray) -> bytes:
    """Places (as steps) and values of the counts that are not 0, up to 65535."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint16).tobytes() + np.minimum(counts[at], 65535).astype(np.uint16).tobytes(), 1)


def _cells(read: DataFrame, p: Join) -> np.ndarray:
    """The order's table: a byte a cell, log2 of how many sets have a shingle of the cell in eighths. Its size is at most that of cell_bits."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << p.cell_bits) // _CHUNKS)
        for blob in pdf["cells"]:
            at, n = np.frombuffer(zlib.decompress(blob), dtype=np.uint16).reshape(2, -1)
            total[np.cumsum(at, dtype=np.int64)] += n
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "cells": [np.minimum(np.ceil(np.log2(total + 1) * 8), 255).astype(np.uint8).tobytes()]})

    out = np.zeros((_CHUNKS, (1 << p.cell_bits) // _CHUNKS), dtype=np.uint8)
    for row in read.filter("chunk is not null").select("chunk", "cells").groupBy("chunk").applyInPandas(add, "chunk int, cells binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["cells"], dtype=np.uint8)
    return out.reshape(-1)


def _marks(rows: DataFrame, th: str, id: str, p: Join) -> np.ndarray:  # noqa: A002
    """A bit for each value of the upper mark_bits of a document's hash, set for those of rows (th, id); packed, of fixed size."""
    low = p.mark_bits - 8

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.unique(batch.column("at").to_numpy().view(np.uint64) >> np.uint64(64 - p.mark_bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(value >> low, prepend=-1))
            parts = np.split((value & ((1 << low) - 1)).astype(np.uint32), at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(value[at] >> low), pa.array([x.tobytes() for x in parts[: len(at)]], pa.binary())], names=["chunk", "found"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << low, dtype=bool)
        for x in pdf["found"]:
            out[np.frombuffer(x, dtype=np.uint32)] = True
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "found": [zlib.compress(np.packbits(out).tobytes(), 1)]})

    out = np.zeros((256, -(-(1 << low) // 8)), dtype=np.uint8)
    told = rows.select(F.xxhash64(th, id).alias("at")).mapInArrow(tell, "chunk long, found binary").groupBy("chunk").applyInPandas(add, "chunk long, found binary")
    for row in told.toLocalIterator():
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["found"]), dtype=np.uint8)
    return out


def _state(at: np.ndarray, tables: list[np.ndarray], p: Join) -> np.ndarray:
    """Of documents by their hashes, 0: not marked in the first table; else 2 if there is a second one in which they are not marked, or 1."""
    low = p.mark_bits - 8
    value = at.view(np.uint64) >> np.uint64(64 - p.mark_bits)
    chunk, cell = (value >> np.uint64(low)).astype(np.intp), (value & np.uint64((1 << low) - 1)).astype(np.intp)
    held = [(x[chunk, cell >> 3] << (cell & 7).astype(np.uint8) & 0x80) > 0 for x in tables]
    return np.where(held[0], np.where(held[-1], 1, 2) if len(held) > 1 else 1, 0).astype(np.int32)


def _sifted(docs: DataFrame, th: str, id: str, wanted: np.ndarray, doubtful: np.ndarray, p: Join) -> DataFrame:  # noqa: A002
    """Those of docs that are marked in wanted, and some others whose bit they share; __sure: not marked in doubtful. Where all that
    are not wanted are doubtful, sure ones are wanted. No row is sent anywhere."""
    tables = [docs.sparkSession.sparkContext.broadcast(x) for x in (wanted, doubtful)]

    @F.pandas_udf("int")
    def state(at: pd.Series) -> pd.Series:
        return pd.Series(_state(at.to_numpy(), [x.value for x in tables], p))

    return docs.withColumn("__state", state(F.xxhash64(th, id))).filter("__state > 0").withColumn("__sure", F.col("__state") == 2).drop("__state")


def _per_set(texts: DataFrame, p: Join, name: str, part, tables: list | None = None) -> DataFrame:
    """node and part(set), named, of each set of a table of texts (_every_set; of state 1), once."""
    return _every_set(texts, p, name, part, tables).groupBy("node").agg(F.first(name).alias(name))


def _every_set(texts: DataFrame, p: Join, name: str, part, tables: list | None = None, state: int = 1) -> DataFrame:
    """node and part(set), named, of the sets of a table of texts; copies that follow each other in a task are left out. tables: with
    them (broadcast) only documents (th, id) of that state are read; they are sifted where they are read, since a second Python worker
    a task stays for a minute."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(p.words), set()
        if tables is not None:
            marks = [x.value for x in tables]
            batches = (x.filter(pa.array(_state(x.column("at").to_numpy(), marks, p) == state)) for x in batches)
        for batch in sliced(batches):
            nodes, parts = [], [np.zeros(0, dtype=np.uint64)]
            if len(known) > 100_000:
                known.clear()
            for _, sets in shingler(raw_texts(batch.column("text"))):
                for u in sets:
                    if len(u) and (node := _node(u)) not in known:
                        known.add(node)
                        nodes.append(node)
                        parts.append(part(u))
            ends = np.cumsum([len(x) for x in parts], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), lists], names=["node", name])

    own = texts.select("text") if tables is None else texts.select("text", F.xxhash64("th", "id").alias("at"))
    return own.mapInArrow(made, f"node binary, {name} array<long>")


def _heads(docs: DataFrame, rows: DataFrame, classes: DataFrame, cells: np.ndarray, p: Join) -> DataFrame:
    """node and head (its first n - ceil(percent n / 100) + 1 shingles in the order) of each set, read from one document of each.

    Heads are about half the input, so they are not shuffled: only those of sets with several documents are made one."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(cells)

    def head(u: np.ndarray) -> np.ndarray:
        key = (table.value[u >> np.uint64(64 - p.cell_bits)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8))
        m = len(u) - -(-p.percent * len(u) // 100) + 1
        first = np.argpartition(key, m - 1)[:m] if m < len(u) else np.arange(len(u))
        return u[first[np.lexsort((u[first], key[first]))]]

    copied = classes.filter("times > 1").select("node")
    marks = [sc.broadcast(x) for x in (_marks(classes, "one.th", "one.id", p), _marks(rows.join(_sized(copied, p), "node", "left_semi"), "th", "id", p))]
    return _every_set(docs, p, "head", head, marks, 2).unionByName(_per_set(docs, p, "head", head, marks))


def _shared(heads: DataFrame, p: Join) -> np.ndarray:
    """A bit for each value of the upper shared_bits of a shingle, set wherever two sets or more may have one in their heads;
    packed, of fixed size. Tasks send 40 bits of each shingle, twice at most."""
    total = heads.agg(F.coalesce(F.sum(F.size("head")), F.lit(0))).first()[0]
    bits = min(max(8, (total >> 20).bit_length()), p.shared_bits - 3)  # of the chunks that are looked at together

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            value = np.repeat(value, np.minimum(times, 2))
            chunk = value >> np.uint64(40 - bits)
            at = np.flatnonzero(np.diff(chunk, prepend=np.uint64(1 << 40)))
            parts = np.split(value.astype(np.uint32), at[1:])
            return pa.RecordBatch.from_arrays([pa.array(chunk[at].astype(np.int64)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "found"])

        for batch in batches:
            held.append(batch.column("head").flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(24))
            n += len(held[-1])
            if n > 1 << 21:
                yield told()
                held, n = [], 0
        if n:
            yield told()

    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        value = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in pdf["found"]]))
        value = value[1:][value[1:] == value[:-1]].astype(np.int64) & ((1 << (40 - bits)) - 1)
        out = np.zeros(1 << (p.shared_bits - bits), dtype=bool)
        out[value >> (40 - p.shared_bits)] = True
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "found": [zlib.compress(np.packbits(out).tobytes(), 1) if out.any() else b""]})

    out = np.zeros((1 << bits, 1 << (p.shared_bits - bits - 3)), dtype=np.uint8)
    found = heads.select("head").mapInArrow(tell, "chunk long, found binary").groupBy("chunk").applyInPandas(twice, "chunk long, found binary")
    for row in found.toLocalIterator():
        if row["found"]:
            out[row["chunk"]] = np.frombuffer(zlib.decompress(row["found"]), dtype=np.uint8)
    return out.reshape(-1)


def _places(heads: DataFrame, shared: np.ndarray, p: Join) -> DataFrame:
    """region (a shingle of a head that is shared), node, place (of it in the head)."""
    table = heads.sparkSession.sparkContext.broadcast(shared)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column("head")
            lens = head.value_lengths().to_numpy(zero_copy_only=False)
            region = head.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lens)), lens)
            place = np.arange(len(region)) - (np.cumsum(lens) - lens)[owner]
            at = region.view(np.uint64) >> np.uint64(64 - p.shared_bits)
            ok = (table.value[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & 0x80) > 0
            owner, place, region = owner[ok], place[ok], region[ok]
            yield pa.RecordBatch.from_arrays([pa.array(region), batch.column("node").take(pa.array(owner)), pa.array(place.astype(np.int64))], names=["region", "node", "place"])

    return heads.mapInArrow(look, "region long, node binary, place long")


def _sized(df: DataFrame, p: Join) -> DataFrame:
    """df, a written table of ids, marked to be sent to every executor if it is small."""
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def _sets(docs: DataFrame, classes: DataFrame, ks: DataFrame, p: Join) -> DataFrame:
    """k and set (all its shingles) of the classes with the given k, read from one document of each."""
    wanted = written(classes.join(ks, "k", "left_semi").select(F.col("one.th").alias("t"), F.col("one.id").alias("i"), "node", "k"))
    if wanted.count() <= p.broadcast_rows:
        sized = F.broadcast(wanted.select("t", "i"))
        texts = docs.join(sized, (docs["th"] == sized["t"]) & docs["id"].eqNullSafe(sized["i"]), "left_semi")
        made = _per_set(texts, p, "set", lambda u: u)
    else:  # a join would shuffle all texts; those that are read in vain are dropped by their nodes
        made = _per_set(docs, p, "set", lambda u: u, [docs.sparkSession.sparkContext.broadcast(_marks(wanted, "t", "i", p))])
    return written(made.join(_sized(wanted.select("node", "k"), p), "node").select("k", "set"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, both (size of the intersection), any (of the union) of pairs of classes, a written table."""
    ends = lambda c: sets.withColumnsRenamed({"k": c, "set": f"set_{c}"}).join(pairs.select(c).distinct(), c, "left_semi")
    joined = pairs.select("x", "y").join(ends("x"), "x").join(ends("y"), "y").withColumn("both", F.size(F.array_intersect("set_x", "set_y")))
    return written(joined.select("x", "y", "both", (F.size("set_x") + F.size("set_y") - F.col("both")).alias("any")))


def _may_link(nx: np.ndarray, ny: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in `apart` shingles at least can be linked: 100 both >= percent any, both + any = nx + ny."""
    both = (nx + ny - apart) // 2
    return (100 * both >= percent * (nx + ny - both)) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))


def _words(column) -> np.ndarray:
    """Sketches of a column as rows of uint64."""
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(-1, _SKETCH // 64)


def _possible(pairs: DataFrame, classes: DataFrame, p: Join) -> DataFrame:
    """Those of pairs (x, y) whose sketches allow a link."""
    ends = lambda c: classes.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny = (batch.column(c).to_numpy() for c in ("x", "y", "nx", "ny"))
            apart = np.bitwise_count(_words(batch.column("sx").to_pylist()) ^ _words(batch.column("sy").to_pylist())).sum(axis=1, dtype=np.int64)
            ok = _may_link(nx, ny, apart, p.percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok])], names=["x", "y"])

    return pairs.join(ends("x"), "x").join(ends("y"), "y").mapInArrow(look, "x long, y long")


def _in_blocks(rows: DataFrame, classes: DataFrame, forest: bool, p: Join) -> DataFrame:
    """x < y of classes that share a region (rows: region, k, comp), are of different components and may be linked. forest: of
    those of a pair of blocks, only as many as join the same components as all do."""
    sizes = rows.groupBy("region").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    told = rows.join(sizes, "region").withColumn("b", F.pmod(F.xxhash64("k", "region"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    dealt = told.select("region", "k", "comp", "b", other).select("region", "k", "comp", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    dealt = dealt.join(classes.select("k", "n", "sketch"), "k")

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n, words, side = pdf["k"].to_numpy(), pdf["n"].to_numpy(), _words(pdf["sketch"]), pdf["b"].to_numpy()
        label = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = (np.arange(len(k)),) * 2 if same else (np.flatnonzero(side == pdf["i"].iloc[0]), np.flatnonzero(side == pdf["j"].iloc[0]))
        found = []
        for a in left.tolist():
            near = right[label[right] != label[a]]
            if same:
                near = near[near > a]
            near = near[100 * np.minimum(n[near], n[a]) >= p.percent * np.maximum(n[near], n[a])]
            if not len(near):
                continue
            near = near[_may_link(n[near], n[a], np.bitwise_count(words[near] ^ words[a]).sum(axis=1, dtype=np.int64), p.percent)]
            if forest and len(near):
                theirs, first = np.unique(label[near], return_index=True)
                near = near[first]
                label[np.isin(label, theirs)] = label[a]
            found += [(k[a], k[b]) for b in near.tolist()]
        out = np.sort(np.array(found, dtype=np.int64).reshape(-1, 2), axis=1)
        return pd.DataFrame({"x": out[:, 0], "y": out[:, 1]})

    return dealt.groupBy("region", "i", "j").applyInPandas(look, "x long, y long").distinct()


def components(edges: DataFrame, p: Join) -> DataFrame:
    """node, comp (the smallest node of its component) of all nodes of edges (x, y), a written table: each node takes the least label
    of its neighbours, then that label's own label, until none changes."""
    both = edges.select("x", "y").union(edges.select("y", "x"))
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("comp")))
    while True:
        known = _sized(labels, p)
        near = both.join(known.select(F.col("node").alias("y"), F.col("comp").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        step = near.join(known, "node").select("node", "comp", F.least("comp", "c").alias("new"))
        jump = known.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        after = written(step.join(jump, "new", "left").select("node", F.col("comp").alias("old"), F.least("new", F.coalesce("jump", "new")).alias("comp")))
        labels = after.select("node", "comp")
        if after.filter("old <> comp").isEmpty():
            return labels


def _named(df: DataFrame, labels: DataFrame | None, p: Join) -> DataFrame:
    """df with comp, the component of its class."""
    if labels is None:
        return df.withColumn("comp", F.col("k"))
    return df.join(_sized(labels.withColumnRenamed("node", "k"), p), "k", "left").withColumn("comp", F.coalesce("comp", "k"))


def _grouped(df: DataFrame, text: str, id: str, p: Join, steps: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """(rows: id, th, n, node, a row a document; node, comp of the sets, n > 0)."""
    docs = df.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    p = replace(p, cell_bits=_cell_bits(docs, p))
    read = written(_read(docs, p))
    rows = read.filter("chunk is null").select("id", "th", "n", "node", "keys", "sketch")
    one = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("times"), F.min(F.struct("th", "id")).alias("one"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = written(with_row_id(one, "k"))
    return rows.select("id", "th", "n", "node"), _named(classes.select("node", "k", "least"), _link(docs, read, rows, classes, p, steps), p)


def jaccard_groups(df: DataFrame, text: str = "text", id: str = "doc_id", params: Join | None = None) -> DataFrame:  # noqa: A002
    """A row a document: its id, n_shingles (long) and component_id, the smallest id reachable by links, itself included.

    Words: runs without white space, A-Z lower-cased. Null texts and texts without words have no shingles and no links;
    texts with fewer words than a shingle have one shingle of all their words. Repeated rows are copies of each other.
    Rows of one id and other texts each have their own links. Null ids take part and are no smallest id; an empty table
    gives an empty one. A very long text is one set in one task's memory, 8 bytes a word. Other columns are not returned.
    """
    p = params or Join()
    rows, named = _grouped(df, text, id, p)
    named = written(named)
    least = written(named.groupBy("comp").agg(F.min("least").alias("component_id")))
    of_node = written(named.join(least, "comp").select("node", "component_id"))
    out = rows.join(_sized(of_node, p), "node", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(df: DataFrame, text: str = "text", id: str = "doc_id", params: Join | None = None) -> DataFrame:  # noqa: A002
    """df with one row of each group of linked documents: that of the smallest id (null ids last), of several with that id the
    one of the least text hash, and of repeated rows with that id and text the least by all columns. Texts without words are
    linked with nothing and all stay. An empty table gives an empty one."""
    p = params or Join()
    rows, named = _grouped(df, text, id, p)
    told = rows.filter("n > 0").groupBy("node", "id", "th").agg(F.count("*").alias("times")).join(named.select("node", "comp"), "node")
    first = told.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "times")).alias("x"))
    first = written(first.select(F.col("x.id").alias("__i"), F.col("x.th").alias("__t"), F.col("x.times").alias("__times")))
    own = [F.col(f"`{c}`") for c in df.columns]
    full = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = df.filter(full).withColumns({"__th": F.xxhash64(F.col(f"`{text}`")), "__id": F.col(f"`{id}`")})
    out, small = df.filter(~full), first.count() <= p.broadcast_rows
    if not small:  # a join would shuffle all texts: it is left to those of which two tables of bits can't tell
        gone = told.join(first, (told["th"] == first["__t"]) & told["id"].eqNullSafe(first["__i"]), "left").filter("__times IS NULL OR __times > 1")
        docs = _sifted(docs, "__th", "__id", _marks(first, "__t", "__i", p), _marks(gone, "th", "id", p), p)
        out, docs = out.unionByName(docs.filter("__sure").select(*own)), docs.filter("NOT __sure")
    sized = F.broadcast(first) if small else first
    found = docs.join(sized, (docs["__th"] == sized["__t"]) & docs["__id"].eqNullSafe(sized["__i"]))
    many = found.filter("__times > 1").groupBy("__i", "__t").agg(F.min(F.struct(*own)).alias("x")).select("x.*")
    return out.unionByName(found.filter("__times = 1").select(*own)).unionByName(many)


def link_steps(df: DataFrame, text: str = "text", id: str = "doc_id", params: Join | None = None) -> dict[str, int]:  # noqa: A002
    """How many links between different texts each step of the join measured: first round, small regions, pivots, blocks. Only those that
    decide a group are measured, and a later step measures none that an earlier one did."""
    steps: dict[str, int] = {}
    _grouped(df, text, id, params or Join(), steps)
    return steps


def _link(docs: DataFrame, read: DataFrame, rows: DataFrame, classes: DataFrame, p: Join, steps: dict[str, int] | None = None) -> DataFrame | None:
    """node (a class's k), comp of the classes with links (written), or None if there are none. steps: gets the number of links by step."""
    fit = 100 * F.least("nx", "ny") >= p.percent * F.greatest("nx", "ny")
    is_link = 100 * F.col("both") >= p.percent * F.col("any")

    def ordered(df: DataFrame) -> DataFrame:
        """Distinct pairs, the smaller class first."""
        return df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def with_sets(pairs: DataFrame, sets: DataFrame | None) -> DataFrame:
        ks = pairs.select(F.col("x").alias("k")).union(pairs.select("y")).distinct()
        made = _sets(docs, classes, ks if sets is None else ks.join(sets.select("k"), "k", "left_anti"), p)
        return made if sets is None else sets.unionByName(made)

    def told(step: str, found: DataFrame) -> DataFrame:
        if steps is not None:
            steps[step] = steps.get(step, 0) + found.filter(is_link).count()
        return found

    def merged(links: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        f = found.filter(is_link).select("x", "y")
        links = written((f if links is None else links.unionByName(f)).distinct())
        return links, None if links.isEmpty() else components(links, p)

    # First round: of the sets with a min-wise key in common, the least is compared with each other one.
    keys = classes.select("k", "n", F.posexplode("keys").alias("j", "key"))
    pivots = written(keys.groupBy("j", "key").agg(F.min(F.struct("k", "n")).alias("p"), F.max("k").alias("last")).filter("p.k < last").select("j", "key", F.col("p.k").alias("y"), F.col("p.n").alias("ny")))
    pairs = ordered(keys.join(pivots, ["j", "key"]).filter("k <> y").select(F.col("k").alias("x"), F.col("n").alias("nx"), "y", "ny").filter(fit))
    pairs = written(_possible(pairs, classes, p))
    sets = with_sets(pairs, None)
    links, labels = merged(None, told("first round", _measured(pairs, sets)))
    dropped(pairs, pivots)

    # Regions of single shingles: those whose sets are not all of one component.
    heads = written(_heads(docs, rows, classes, _cells(read, p), p))
    each = _places(heads, _shared(heads, p), p).join(_named(classes.select("node", "k", "n"), labels, p), "node")
    each = written(each.select("region", "k", "n", "comp", (F.col("n") - F.col("place")).alias("left")))
    live = written(each.groupBy("region").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).filter("a < b").select("region", "size"))
    rows = written(each.join(_sized(live, p), "region"))
    dropped(heads, live, each)
    small, large = rows.filter(F.col("size") <= p.leaf), rows.filter(F.col("size") > p.leaf)
    left, right = (small.select("region", *(F.col(x).alias(x + c) for x in ("k", "n", "comp", "left"))) for c in "xy")
    need = p.percent * (F.col("nx") + F.col("ny")) / (100 + p.percent) - 1e-6  # shingles that a link has in common
    met = left.join(right, "region").filter("kx < ky AND compx <> compy").filter(fit & (F.least("leftx", "lefty") >= need))
    pairs = written(_possible(ordered(met.select(F.col("kx").alias("x"), F.col("ky").alias("y"))), classes, p))

    # Larger ones: a pivot each; distances from it on whole sets; rings with their windows.
    pivot = large.groupBy("region").agg(F.min(F.struct(F.xxhash64("k").alias("h"), "k")).alias("p")).select("region", F.col("p.k").alias("pivot"))
    near = written(large.join(pivot, "region").select("pivot", "k", "comp").distinct())
    spokes = written(ordered(near.filter("k <> pivot").select(F.col("k").alias("x"), F.col("pivot").alias("y"))))
    sets = with_sets(pairs.unionByName(spokes), sets)
    far = told("pivots", _measured(spokes, sets))
    links, labels = merged(links, far.unionByName(told("small regions", _measured(pairs, sets))))
    step = 1 - p.percent / 100
    ring = F.least(F.floor((1 - F.col("both") / F.col("any")) / step + 1e-9), F.lit(int(1 / step + 1e-9) - 1))
    apart = near.drop("comp").filter("k <> pivot").withColumns({"x": F.least("k", "pivot"), "y": F.greatest("k", "pivot")}).join(far, ["x", "y"])
    cut = apart.select("pivot", "k", ring.alias("home"), F.explode(F.array(ring, ring - 1)).alias("ring"))
    cut = written(cut.select(F.concat_ws("/", "pivot", "ring").alias("region"), "k", (F.col("ring") == F.col("home")).alias("inner")))
    dropped(pairs, spokes, near, rows)
    tried = far
    for forest in (True, False):
        named = written(_named(cut, labels, p))
        open_ = named.groupBy("region").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.bool_or("inner").alias("own")).filter("a < b AND own").select("region")
        pairs = _in_blocks(named.join(open_, "region", "left_semi"), classes, forest, p)
        pairs = written(pairs.join(tried.select("x", "y"), ["x", "y"], "left_anti"))
        if not pairs.isEmpty():
            sets = with_sets(pairs, sets)
            found = told("blocks", _measured(pairs, sets))
            tried = tried.select("x", "y").unionByName(found.select("x", "y"))
            links, labels = merged(links, found)
        dropped(named)
    return labels
