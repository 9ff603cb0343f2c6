"""Similar entities without all pairs: blocks of entities that lie near each other, and only those pairs of blocks, or of
entities, whose bound still reaches somebody's k-th best."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import best, warped
from quern.sources.shared import kept

_BITS = 6


def _curve(places: list[Column]) -> Column:
    """Numbers in [0, 1] as one, their bits in turn: near in all is near in it."""
    cells = [F.least(F.floor(F.coalesce(x, F.lit(0.0)) * (1 << _BITS)), F.lit((1 << _BITS) - 1)) for x in places]
    out = F.lit(0).cast("long")
    for bit in reversed(range(_BITS)):
        for c in cells:
            out = F.shiftleft(out, 1) + F.shiftright(c, bit) % 2
    return out


def in_blocks(entities: DataFrame, order: list[str], block: int) -> DataFrame:
    """entities with a block of about `block` neighbours in the order, written; equal ones are split by what stands last in it."""
    n = entities.count()
    return kept(entities.repartitionByRange(max(1, -(-n // block)), *order).withColumn("block", F.spark_partition_id()), "blocks")


def _profiles(series: DataFrame, entity: str, item: str, value: str) -> DataFrame:
    """entity, told (item, mean, deviation, range over all entities by item), signature of its items, place on a curve through means and deviations."""
    some = series.filter(F.col(value).isNotNull())
    stats = some.groupBy(F.col(entity).alias("entity"), F.col(item).alias("item")).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    spread = some.groupBy(F.col(item).alias("item")).agg(F.min(value).alias("low"), (F.max(value) - F.min(value)).alias("range"))
    told = stats.join(spread, "item").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("item", "m", "s", "range", "low"))).alias("told"))
    places = [p for k in range(4) for x in [F.get("told", F.lit(k))] for p in (F.try_divide(x["m"] - x["low"], x["range"]), F.try_divide(2 * x["s"], x["range"]))]
    return told.withColumns({"signature": F.xxhash64(F.transform("told", lambda x: x["item"])), "z": _curve(places)})


def _block_bounds(rows: DataFrame) -> DataFrame:
    """i, j, bound: no entity of block i is more similar than that to one of block j (i and j differ, and share an item).

    Where all entities of a block have the same items the bound is the mean over the shared ones, else the largest: a mean over
    any of them is no higher."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("size"))
    each = rows.select("block", F.inline("told"))
    box = each.groupBy("block", "item").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "ms" for f in (F.min, F.max)], F.max("range").alias("range"), F.count("*").alias("n"))
    box = box.join(sizes, "block")
    even = box.groupBy("block").agg(F.bool_and(F.col("n") == F.col("size")).alias("even"))
    box = box.join(even, "block").drop("n", "size")
    left, right = (box.select("item", F.col("block").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("min_m", "max_m", "min_s", "max_s", "range", "even")]) for x in "ij")
    gap = lambda c: F.greatest(F.col(f"min_{c}_i") - F.col(f"max_{c}_j"), F.col(f"min_{c}_j") - F.col(f"max_{c}_i"), F.lit(0.0))
    one = F.when(F.col("range_i") > 0, 1 - (gap("m") + gap("s")) / (2 * F.col("range_i"))).otherwise(1.0)
    both = left.join(right, "item").filter("i <> j").select("i", "j", one.alias("x"), (F.col("even_i") & F.col("even_j")).alias("even"))
    return both.groupBy("i", "j").agg(F.when(F.bool_and("even"), F.avg("x")).otherwise(F.max("x")).alias("bound"))


def _compared(k: int, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k most similar entities of b for each of a, of those that reach its floor."""

    def table(rows: pd.DataFrame, items: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        m, s = (np.full((len(rows), len(items)), np.nan) for _ in range(2))
        for n, told in enumerate(rows["told"]):
            for x in told:
                if x["item"] in items:
                    m[n, items[x["item"]]], s[n, items[x["item"]]] = x["m"], x["s"]
        return m, s

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "similarity": []})
        if not len(a) or not len(b):
            return none
        b = b.sort_values("entity", ignore_index=True)
        ranges = {x["item"]: x["range"] for told in a["told"] for x in told}
        items = {x: n for n, x in enumerate(sorted(ranges))}
        (ma, sa), (mb, sb) = table(a, items), table(b, items)
        total, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), dtype=np.int32)
        for item, n in items.items():
            away = np.abs(ma[:, n, None] - mb[None, :, n]) + np.abs(sa[:, n, None] - sb[None, :, n])
            has = ~np.isnan(away)
            one = np.clip(1 - away / (2 * ranges[item]), 0.0, 1.0) if ranges[item] > 0 else 1.0
            total += np.where(has, one, 0.0)
            shared += has
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.round(total / shared, digits)
        score[(shared == 0) | (a["entity"].to_numpy()[:, None] == b["entity"].to_numpy()[None, :])] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(score, top, axis=1)
        out = pd.DataFrame({"a": np.repeat(a["entity"].to_numpy(), top.shape[1]), "b": b["entity"].to_numpy()[top].ravel(), "similarity": got.ravel()})
        floor = np.repeat(a["floor"].to_numpy(dtype=float), top.shape[1]) if "floor" in a else -np.inf
        return out[(out["similarity"] >= floor) & np.isfinite(out["similarity"])]

    return compare


def stat_neighbours(series: DataFrame, entity: str, item: str, value: str, k: int, block: int = 1024, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(a, rank, b, similarity: the k most similar entities of each, ties to the smaller b; i, j: the pairs of blocks compared).

    The similarity of two entities is 1 - (|mean difference| + |deviation difference|) / (2 range), in [0, 1], averaged over the
    items that both have, to `digits` places. Exact: blocks compare themselves first, and then only those others whose bound
    reaches the lowest k-th score in the block. A task holds two blocks, however many entities are alike. Bounds are made for all
    pairs of blocks: (entities / block) squared, times the items two blocks share. Rows without a value
    say nothing; entities that share no item are not neighbours."""
    rows = in_blocks(_profiles(series, entity, item, value), ["signature", "z", "entity"], block)
    kind = dict(rows.dtypes)["entity"]
    schema = f"a {kind}, b {kind}, similarity double"
    compare = _compared(k, digits)
    own = kept(rows.select("block", "entity", "told").groupBy("block").applyInPandas(lambda x: compare(x, x), schema), "own")
    own = best(own, "a", "similarity", "b", k)
    floor = own.filter(F.col("rank") == k).select(F.col("a").alias("entity"), F.col("similarity").alias("floor"))
    rows = kept(rows.select("block", "entity", "told").join(floor, "entity", "left").fillna(float("-inf"), ["floor"]), "floors")
    least = rows.groupBy(F.col("block").alias("i")).agg(F.min("floor").alias("least"))
    pairs = kept(_block_bounds(rows).join(least, "i").filter(F.col("bound") >= F.col("least") - 10.0**-digits).select("i", "j"), "pairs")
    left = rows.withColumnRenamed("block", "i").join(pairs, "i").select("i", "j", "entity", "told", "floor")
    right = _again(rows).withColumnRenamed("block", "j").join(_again(pairs), "j").select("i", "j", "entity", "told")
    away = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, schema)
    return best(own.drop("rank").unionByName(away), "a", "similarity", "b", k).select("a", "rank", "b", "similarity"), pairs


def _packed_blocks(series: DataFrame, entity: str, item: str, value: str, label: Column, block: int) -> DataFrame:
    """A row a block of about `block` entities: labels, items with their range over all entities, and has, m, s (entities x items) as bytes."""
    stats = series.groupBy(F.col(entity).alias("entity"), F.col(item).alias("item")).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    spread = series.groupBy(F.col(item).alias("item")).agg((F.max(value) - F.min(value)).alias("range"))
    told = kept(stats.join(spread, "item").filter("entity IS NOT NULL").withColumn("label", label), "told")
    blocks = max(1, -(-told.select("entity").distinct().count() // block))
    kinds = dict(told.dtypes)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        who, first, at = np.unique(pdf["entity"].to_numpy(), return_index=True, return_inverse=True)
        what, items = pd.factorize(pdf["item"], sort=True)
        has = np.zeros((len(items), len(who)), dtype=bool)
        m, s, ranges = np.zeros(has.shape), np.zeros(has.shape), np.zeros(len(items))
        has[what, at], m[what, at], s[what, at], ranges[what] = True, pdf["m"], pdf["s"], pdf["range"]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "labels": [pdf["label"].to_numpy()[first].tolist()], "items": [list(items)], "ranges": [ranges.tolist()], "has": [has.tobytes()], "m": [m.tobytes()], "s": [s.tobytes()]})

    schema = f"block long, labels array<{kinds['label']}>, items array<{kinds['item']}>, ranges array<double>, has binary, m binary, s binary"
    return kept(told.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks))).groupBy("block").applyInPandas(pack, schema), "packed")


def _similarity_sums(digits: int, tile: int = 512) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the pairs between the two blocks of a group (within, if it has one): same (label), n, total of similarities rounded to `digits`
    places, in units of the last one."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf.iloc[0], pdf.iloc[-1]]
        within = len(pdf) == 1
        items = sorted(set(sides[0]["items"]) & set(sides[1]["items"]))
        ranges = dict(zip(sides[0]["items"], sides[0]["ranges"], strict=True))
        tables = []
        for x in sides:
            at = [list(x["items"]).index(i) for i in items]
            tables.append([np.frombuffer(x[c], dtype=d).reshape(len(x["items"]), -1)[at] for c, d in (("has", bool), ("m", float), ("s", float))])
        (ha, ma, sa), (hb, mb, sb) = tables
        labels = [np.array(x["labels"]) for x in sides]
        n, total = np.zeros(2, dtype=np.int64), [0, 0]
        for p in range(0, len(labels[0]), tile):
            for q in range(p if within else 0, len(labels[1]), tile):
                a, b = slice(p, p + tile), slice(q, q + tile)
                shape = len(labels[0][a]), len(labels[1][b])
                x, shared = np.zeros(shape), np.zeros(shape)
                for k, item in enumerate(items):
                    one = np.abs(ma[k, a, None] - mb[k, None, b])
                    one += np.abs(sa[k, a, None] - sb[k, None, b])
                    if ranges[item] > 0:
                        one /= -2 * ranges[item]
                        one += 1.0
                        np.clip(one, 0.0, 1.0, out=one)
                        one[np.isnan(one)] = 1.0  # no value on one side
                    else:
                        one[:] = 1.0
                    if ha[k, a].all() and hb[k, b].all():
                        x += one
                        shared += 1.0
                    else:
                        both = ha[k, a, None] & hb[k, None, b]
                        x += np.where(both, one, 0.0)
                        shared += both
                ok = shared > 0
                if within and p == q:
                    ok &= np.triu(np.ones(shape, dtype=bool), 1)
                np.divide(x, shared, out=x, where=ok)
                x *= 10.0**digits
                np.rint(x, out=x)
                x[~ok] = 0.0  # whole numbers: their sum is exact
                same = labels[0][a, None] == labels[1][None, b]
                alike = (x * same).sum()
                total = [total[0] + int(x.sum() - alike), total[1] + int(alike)]
                n += [np.count_nonzero(ok & ~same), np.count_nonzero(ok & same)]
        return pd.DataFrame({"same": [False, True], "n": n, "total": total})

    return sums


def mean_similarity(series: DataFrame, entity: str, item: str, value: str, label: Column, block: int = 8192, digits: int = 6) -> DataFrame:
    """same, mean: of the similarities (as in stat_neighbours, each rounded to `digits` places) of all pairs of entities that share an
    item, those with one label and the others; label: of the column entity.

    All pairs are compared, but none is a row: a task holds two packed blocks and tells two sums. Work grows with the square of
    entities, what is shuffled with entities times blocks. Entities without any value for an item that they have are alike in it."""
    packed = _packed_blocks(series, entity, item, value, label, block)
    places = packed.agg(F.sort_array(F.collect_list("block")).alias("every")).first()["every"]
    other = F.explode(F.array(*[F.lit(x) for x in places]) if places else F.array().cast("array<long>")).alias("o")
    dealt = packed.select("*", other).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    sums = dealt.groupBy("i", "j").applyInPandas(_similarity_sums(digits), "same boolean, n long, total long")
    told = sums.groupBy("same").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).filter("n > 0")
    return told.select("same", (F.col("total").cast("double") / F.col("n") / 10.0**digits).alias("mean"))


def _again(df: DataFrame) -> DataFrame:
    """df under columns of its own, to meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


# Time warping


def nearest_costs(values: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared distance of each value to the nearest one of a series."""
    held = np.sort(other)
    at = np.searchsorted(held, values)
    return np.minimum((values - held[np.maximum(at - 1, 0)]) ** 2, (values - held[np.minimum(at, len(held) - 1)]) ** 2)


def value_bound(x: np.ndarray, y: np.ndarray) -> float:
    """No warping of two series is cheaper: a path meets both ends, and each value of one series some value of the other."""
    ends = (x[0] - y[0]) ** 2 + ((x[-1] - y[-1]) ** 2 if len(x) > 1 or len(y) > 1 else 0.0)
    if min(len(x), len(y)) == 1:
        return float(np.sqrt(ends))
    return float(np.sqrt(ends + max(nearest_costs(x[1:-1], y).sum(), nearest_costs(y[1:-1], x).sum())))


#: So many entities of the smallest ids are looked through for series of the same shape.
_FIRST = 4096
_CELLS = 128


class _Column:
    """The series of one item in a block: runs of equal values, padded."""

    def __init__(self, n: int, told: list[tuple[int, list[float], list[int]]]) -> None:
        width = max(len(v) for _, v, _ in told)
        self.has, self.values, self.times = np.zeros(n, dtype=bool), np.full((width, n), np.inf), np.zeros((width, n), dtype=np.int64)
        self.first, self.last = np.zeros(n), np.zeros(n)
        for at, v, t in told:
            self.has[at], self.values[: len(v), at], self.times[: len(v), at], self.first[at], self.last[at] = True, v, t, v[0], v[-1]
        self.sizes = self.times.sum(axis=0)
        self.inner = self.times.copy()  # without both ends
        self.inner[0] -= 1
        self.inner[(self.times > 0).sum(axis=0) - 1, np.arange(n)] -= 1
        self.inner = np.maximum(self.inner, 0)

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Series of the same length, a row each."""
        return np.repeat(self.values.T[at].ravel(), self.times.T[at].ravel()).reshape(len(at), -1)

    def cells(self, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(inner values in each cell, squared distance at least of what is in a cell to the nearest value): entities x cells."""
        n = self.values.shape[1]
        held, near = np.zeros((n, _CELLS)), np.full((n, _CELLS), np.inf)
        start = low + width * np.arange(_CELLS)
        for v, t in zip(self.values, self.inner, strict=True):
            some = np.flatnonzero(np.isfinite(v))
            cell = np.clip(((v[some] - low) / width).astype(np.int64), 0, _CELLS - 1)
            np.add.at(held, (some, cell), t[some])
            away = np.maximum(start - v[some, None], v[some, None] - start - width) - 1e-6 * width  # a value at an edge may be in the cell beside
            near[some] = np.minimum(near[some], np.maximum(away, 0.0) ** 2)
        near[~self.has] = 0.0
        return held, near


class _Block:
    """Entities of a block; columns: their series by item."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, self.labels, self.floor = rows["entity"].to_numpy(), rows["label"].tolist(), rows["floor"].to_numpy(dtype=float).copy()
        self.open = self.floor < np.inf  # the others look for nobody
        told: dict[str, list] = {}
        for at, every in enumerate(rows["told"]):
            for x in every:
                told.setdefault(x["item"], []).append((at, x["values"], x["times"]))
        self.columns = {i: _Column(len(rows), x) for i, x in told.items()}
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.heaps: list[list[float]] = [[] for _ in self.ids]

    def tell(self, who: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> None:
        mine = self.open[who] & (score >= self.floor[who])
        self.found.append((who[mine], other[mine], score[mine]))
        for n, x in zip(who[mine].tolist(), score[mine].tolist(), strict=True):
            heap = self.heaps[n]
            heapq.heappush(heap, x)
            if len(heap) > k:
                heapq.heappop(heap)
            if len(heap) == k and heap[0] > self.floor[n]:
                self.floor[n] = heap[0]

    def best(self, k: int) -> pd.DataFrame:
        who, other, score = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, dtype=np.int64), self.ids[:0], np.zeros(0))
        good = score >= self.floor[who]
        out = pd.DataFrame({"a": self.ids[who[good]], "b": other[good], "similarity": score[good]})
        return out.sort_values(["similarity", "b"], ascending=[False, True]).groupby("a").head(k) if len(out) else out


def _nearest(x: _Column, p: np.ndarray, y: _Column, q: np.ndarray) -> np.ndarray:
    """For each pair, what the inner values of a series of x cost at the nearest values of one of y."""
    out, theirs = np.zeros(len(p)), [v[q] for v in y.values]
    for v, t in zip(x.values, x.inner, strict=True):
        times = t[p]
        some = np.flatnonzero(times)
        if len(some):
            mine = v[p[some]]
            out[some] += times[some] * np.minimum.reduce([np.abs(o[some] - mine) for o in theirs]) ** 2
    return out


def _warp_blocks(weights: dict[str, float], k: int, bonus: float, chunk: int = 1024, tile: int = 1 << 18, dense: int = 256) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k most similar entities of each open one of two blocks, of pairs between them (within, if they are one), and what it took."""

    def similar(d: np.ndarray, same: np.ndarray) -> np.ndarray:
        return np.where(same, bonus, 1.0) / (1 + d)

    def limits(f: np.ndarray, g: np.ndarray, same: np.ndarray) -> np.ndarray:
        """The largest distance with which a pair is among the k best of one of the two."""
        least = np.minimum(f, g)
        some = least > 0
        return np.where(some, np.where(same, bonus, 1.0) / np.where(some, least, 1.0) - 1 + 1e-9, np.inf)

    def meet(rows: pd.DataFrame, others: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(rows) or (others is not None and not len(others)):
            return pd.DataFrame(columns=["a", "b", "similarity", "pairs", "by_ends", "by_values", "abandoned"])
        a = _Block(rows)
        b = a if others is None else _Block(others)
        items = sorted(a.columns.keys() & b.columns.keys())
        counts = dict.fromkeys(("pairs", "by_ends", "by_values", "abandoned"), 0)
        codes: dict = {}
        labels = [np.array([codes.setdefault(x, len(codes)) if x == x else -1 - side for x in block.labels]) for side, block in enumerate((a, b))]  # NaN is like none
        cells = {}
        for i in items:
            held = [c.values[np.isfinite(c.values)] for c in (a.columns[i], b.columns[i])]
            low, high = min(x.min() for x in held), max(x.max() for x in held)
            width = (high - low) / _CELLS or 1.0
            cells[i] = [c.cells(low, width) for c in (a.columns[i], b.columns[i])]
        step = max(1, tile // len(b.ids))
        for top in range(0, len(a.ids), dense):
            parts = []
            for at in range(top, min(top + dense, len(a.ids)), step):
                r = slice(at, min(at + step, top + dense))
                parts.append([x + (at if n == 0 else 0) for n, x in enumerate(far(a, b, r, items, cells, labels, counts))])
            follow(a, b, *(np.concatenate(x) for x in zip(*parts, strict=True)), items, labels, counts)
        out = [a.best(k)] if a is b else [a.best(k), b.best(k)]
        return pd.concat([*[x for x in out if len(x)], pd.DataFrame([counts])])

    def far(a: _Block, b: _Block, r: slice, items: list[str], cells: dict, labels: list[np.ndarray], counts: dict) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of the slice, place in b) that bounds by ends and by cells of values leave."""
        shape = len(a.ids[r]), len(b.ids)
        weight, ends, values = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for i in items:
            x, y, w = a.columns[i], b.columns[i], weights.get(i, 1.0)
            both = (x.has[r, None] & y.has) * w
            away = (x.first[r, None] - y.first) ** 2
            away += ((x.sizes[r, None] > 1) | (y.sizes > 1)) * (x.last[r, None] - y.last) ** 2
            (ha, na), (hb, nb) = cells[i]
            more = np.maximum(ha[r] @ nb.T, na[r] @ hb.T)
            more += away
            ends += both * np.sqrt(away)
            values += both * np.sqrt(more)
            weight += both
        todo = (weight > 0) & (a.open[r, None] | b.open)
        if a is b:
            todo &= np.arange(len(a.ids))[r, None] < np.arange(len(b.ids))
        limit = limits(a.floor[r, None], b.floor, labels[0][r, None] == labels[1])
        most = np.where(todo, limit, 0.0) * weight * (1 + 1e-9) + 1e-12
        near = todo & (ends <= most)
        left = near & (values <= most)
        n, m, o = (int(np.count_nonzero(x)) for x in (todo, near, left))
        counts["pairs"], counts["by_ends"], counts["by_values"] = counts["pairs"] + n, counts["by_ends"] + n - m, counts["by_values"] + m - o
        return np.nonzero(left)

    def follow(a: _Block, b: _Block, p: np.ndarray, q: np.ndarray, items: list[str], labels: list[np.ndarray], counts: dict) -> None:
        """Bounds by all values, and then the pairs themselves, for each entity from the least bound."""
        w, lows = np.zeros((len(items), len(p))), np.zeros((len(items), len(p)))
        for at in range(0, len(p), 1 << 14):
            s = slice(at, at + (1 << 14))
            for n, i in enumerate(items):
                x, y = a.columns[i], b.columns[i]
                both = np.flatnonzero(x.has[p[s]] & y.has[q[s]])
                c, d = p[s][both], q[s][both]
                ends = (x.first[c] - y.first[d]) ** 2 + ((x.sizes[c] > 1) | (y.sizes[d] > 1)) * (x.last[c] - y.last[d]) ** 2
                lows[n, at + both] = np.sqrt(ends + np.maximum(_nearest(x, c, y, d), _nearest(y, d, x, c)))
                w[n, at + both] = weights.get(i, 1.0)
        sums = w.sum(axis=0)
        low = (w * lows).sum(axis=0) / sums
        order = np.lexsort((low, p))
        begins = np.searchsorted(p[order], np.arange(len(a.ids)))
        turn = np.empty(len(p), dtype=np.int64)
        turn[order] = np.arange(len(p)) - begins[p[order]]  # a pair's place among those of its entity
        open_ = order[np.argsort(turn[order], kind="stable")]
        same = labels[0][p] == labels[1][q]
        some = min(chunk, max(64, 2 * len(np.unique(p))))
        while len(open_):
            limit = limits(a.floor[p[open_]], b.floor[q[open_]], same[open_])
            good = low[open_] <= limit * (1 + 1e-12) + 1e-12
            counts["by_values"] += int(np.count_nonzero(~good))
            open_, limit = open_[good], limit[good]
            now, limit, open_ = open_[:some], limit[:some], open_[some:]
            room, total = limit * sums[now] - (w[:, now] * lows[:, now]).sum(axis=0) + 1e-12, np.zeros(len(now))  # beyond its bounds, for all items together
            for n, i in enumerate(items):
                x, y, alive = a.columns[i], b.columns[i], np.ones(len(now), dtype=bool)
                both = np.flatnonzero(w[n, now] > 0)
                sizes = x.sizes[p[now]] << 32 | y.sizes[q[now]]
                for size in np.unique(sizes[both]).tolist():
                    z = both[sizes[both] == size]
                    d = warped(x.whole(p[now[z]]), y.whole(q[now[z]]), lows[n, now[z]] + room[z] / w[n, now[z]])
                    alive[z] = d < np.inf
                    z, d = z[d < np.inf], d[d < np.inf]
                    room[z] -= w[n, now[z]] * (d - lows[n, now[z]])
                    total[z] += w[n, now[z]] * d
                counts["abandoned"] += int(np.count_nonzero(~alive))
                now, room, total = now[alive], room[alive], total[alive]
            score = similar(total / sums[now], same[now])
            a.tell(p[now], b.ids[q[now]], score, k)
            b.tell(q[now], a.ids[p[now]], score, k)

    return meet


def _as_runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, how often each) of the runs of equal values in a series."""
    v = np.asarray(v, dtype=float)
    at = np.append(0, np.flatnonzero(v[1:] != v[:-1]) + 1)
    return v[at], np.diff(np.append(at, len(v)))


def _alike(first: list, k: int, bonus: float, tile: int = 256) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Entities with their series as runs, and alike: the first k of `first` (entity, label, told with shapes) that nobody is more
    similar than, null where these are fewer than k."""
    places = {x["entity"]: n for n, x in enumerate(first)}
    ids, near = [x["entity"] for x in first], np.array([x["label"] for x in first], dtype=object)

    def table(every: list, items: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        has, shape = np.zeros((len(items), len(every)), dtype=bool), np.zeros((len(items), len(every)), dtype=np.int64)
        for n, told in enumerate(every):
            for x in told:
                if x["item"] in items:
                    has[items[x["item"]], n], shape[items[x["item"]], n] = True, x["shape"]
        return has, shape

    items = {i: n for n, i in enumerate(sorted({y["item"] for x in first for y in x["told"]}))}
    theirs = table([x["told"] for x in first], items)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            has, shape = table(pdf["told"].tolist(), items)
            labels, found = np.array(pdf["label"].tolist(), dtype=object), [None] * len(pdf)
            own = np.array([places.get(e, -1) for e in pdf["entity"]])
            for at in range(0, len(pdf), tile):
                r = slice(at, at + tile)
                shared, other = np.zeros((2, len(own[r]), len(ids)), dtype=bool)
                for n in range(len(items)):
                    both = has[n, r, None] & theirs[0][n]
                    shared |= both
                    other |= both & (shape[n, r, None] != theirs[1][n])
                shared &= ~other
                shared &= own[r, None] != np.arange(len(ids))
                if bonus != 1.0:
                    shared &= (labels[r, None] == near) == (bonus > 1.0)
                many = shared.sum(axis=1)
                q = np.nonzero(shared)[1]
                for n, end, c in zip(range(at, at + tile), np.cumsum(many).tolist(), many.tolist(), strict=False):
                    if c >= k:
                        found[n] = [ids[x] for x in q[end - c : end - c + k]]
            runs = [[{"item": x["item"], "values": v, "times": t} for x in told for v, t in [_as_runs(x["v"])]] for told in pdf["told"]]
            yield pd.DataFrame({"entity": pdf["entity"], "label": pdf["label"], "z": pdf["z"], "told": runs, "alike": found})

    return find


def _shape(v: Column) -> Column:
    """A hash of a series without repeats of the value before: two series warp onto each other at no cost if it is the same."""
    return F.xxhash64(F.filter(v, lambda x, n: (n == 0) | (x != F.get(v, n - 1))))


def _warped_rows(series: DataFrame, k: int, weights: dict[str, float] | None, label_bonus: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, similarity of entities that are settled by shape; pairs and work of the others; all entities)."""
    weights = weights or {}
    light = [i for i, w in weights.items() if w < 0.05]
    some = series.filter(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.isnull(x) | F.isnan(x)))
    if light:
        some = some.filter(~F.col("item").isin(light))
    told = F.sort_array(F.collect_list(F.struct("item", F.col("v").cast("array<double>").alias("v"))))
    entities = some.groupBy("entity").agg(told.alias("told"), F.first("label").alias("label"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    places = [p for n in range(4) for x in [F.get("told", F.lit(n))["v"]] for p in (F.get(x, F.lit(0)), mean(x))]
    shapes = F.transform("told", lambda x: F.struct(x["item"].alias("item"), x["v"].alias("v"), _shape(x["v"]).alias("shape")))
    entities = kept(entities.select("entity", "label", shapes.alias("told"), _curve(places).alias("z")), "entities")
    kinds = dict(entities.dtypes)
    bare = F.transform("told", lambda x: F.struct(x["item"].alias("item"), x["shape"].alias("shape")))
    first = entities.filter("entity IS NOT NULL").select("entity", "label", bare.alias("told")).orderBy("entity").limit(_FIRST).collect()
    schema = f"entity {kinds['entity']}, label {kinds['label']}, z long, told array<struct<item:{dict(series.dtypes)['item']},values:array<double>,times:array<int>>>, alike array<{kinds['entity']}>"
    rows = kept(entities.mapInPandas(_alike(first, k, label_bonus), schema), "alike")
    settled = rows.select(F.col("entity").alias("a"), F.explode("alike").alias("b")).withColumn("similarity", F.lit(max(1.0, float(label_bonus))))

    schema = f"a {kinds['entity']}, b {kinds['entity']}, similarity double, pairs long, by_ends long, by_values long, abandoned long"
    meet = _warp_blocks(weights, k, label_bonus)
    open_ = in_blocks(rows.filter("alike IS NULL"), ["z", "entity"], block).select("block", "entity", "label", "told")
    own = kept(open_.withColumn("floor", F.lit(float("-inf"))).groupBy("block").applyInPandas(lambda x: meet(x), schema), "own")
    floor = best(own.filter("b IS NOT NULL"), "a", "similarity", "b", k).filter(F.col("rank") == k).select(F.col("a").alias("entity"), F.col("similarity").alias("floor"))
    open_ = kept(open_.join(floor, "entity", "left").fillna(float("-inf"), ["floor"]), "floors")
    blocks = open_.agg(F.max("block")).first()[0] or 0
    left = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks)))).filter("other > block")
    right = _again(open_).withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks)))).filter("other > block")
    away = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(lambda p, q: meet(p, q), schema)

    rest = in_blocks(rows.filter("alike IS NOT NULL"), ["entity"], 16 * block).select(F.col("block").alias("other"), "entity", "label", "told", F.lit(float("inf")).alias("floor"))
    others = rest.agg(F.max("other")).first()[0]
    wide = F.floor(F.col("block") / 4).alias("block")  # larger blocks, so that fewer copies of the settled ones are sent
    left = _again(open_).select(wide, "entity", "label", "told", "floor").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(-1 if others is None else others), F.lit(1))) if others is not None else F.lit(None).cast("int"))
    right = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks // 4).cast("long"))))
    beside = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(lambda p, q: meet(p, q), schema)
    return settled, own.unionByName(away).unionByName(beside), rows


def dtw_topk(series: DataFrame, k: int, weights: dict[str, float] | None = None, label_bonus: float = 1.0, block: int = 512) -> DataFrame:
    """a, rank, b, similarity = 1 / (1 + weighted mean warping distance over the items both have), ties to the smaller b.
    series: entity, item, v (array), label.

    Items of weight under 0.05, series of zeros alone and those with a null or NaN are left out. With label_bonus over 1 equal
    labels count more: that leaks labels into features and is off. Exact: two series without repeats of the value before warp onto
    each other at no cost if they are the same, so an entity is settled by k others, among those of the smallest ids, all of whose
    shared items have its shapes. Those that are not meet everybody: pairs of blocks are dealt to tasks; a pair is warped only if
    bounds by its ends, by cells of its values and by all of its values reach the k-th best of one of the two, and given up as soon
    as its path can't."""
    settled, pairs, _ = _warped_rows(series, k, weights, label_bonus, block)
    pairs = settled.unionByName(pairs.filter("b IS NOT NULL").select("a", "b", "similarity"))
    return best(pairs, "a", "similarity", "b", k).select("a", "rank", "b", "similarity")


def dtw_work(series: DataFrame, k: int, weights: dict[str, float] | None = None, label_bonus: float = 1.0, block: int = 512) -> DataFrame:
    """pairs (of entities that share an item), how many of them are settled by shape, and how many of the others each bound kept from
    being warped whole: by_ends, by_values, abandoned."""
    _, pairs, rows = _warped_rows(series, k, weights, label_bonus, block)
    met = pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "by_ends", "by_values", "abandoned")])
    kinds = rows.filter("alike IS NOT NULL").groupBy(F.transform("told", lambda x: x["item"]).alias("items")).agg(F.count("*").alias("n"))
    both = kinds.crossJoin(kinds.select(F.col("items").alias("theirs"), F.col("n").alias("m"))).filter(F.arrays_overlap("items", "theirs"))
    settled = both.agg(F.coalesce(F.sum(F.when(F.col("items") == F.col("theirs"), F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("m"))) / 2, F.lit(0)).cast("long").alias("settled"))
    return met.crossJoin(settled).select((F.col("pairs") + F.col("settled")).alias("pairs"), "settled", "by_ends", "by_values", "abandoned")
