"""Runs: maximal stretches of words that repeat with a period, found on a harmonic grid.

A run of period p and at least e whole periods covers e neighbouring places 0, p, 2p ... of the grid of p. Between two such
places jp and (j + 1)p the words agree as far forward as their longest common extension (LCE) and as far backward as that of
the words before them: together with p that is the whole run. An LCE is the least common prefix between two ranks of the
suffix array, found in a table of range minima; backward ones come from the reversed words. All of it is on arrays over many
texts at once, each text closed by a mark that no other has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quern.llm.common import WORD, raw_texts, weighed

RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


class Extensions:
    """Longest common extensions of suffixes of an array whose last symbol stands nowhere else: suffix array by doubling,
    common prefixes of neighbours in it, range minima."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        _, rank = np.unique(symbols, return_inverse=True)
        ranks, width = [rank.astype(np.int32)], 1
        while width < n and int(ranks[-1].max()) < n - 1:
            last = ranks[-1].astype(np.int64)
            key = last * (n + 1)
            key[: n - width] += last[width:] + 1
            order = np.argsort(key)
            new = np.empty(n, dtype=np.int32)
            new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            ranks.append(new)
            width *= 2
        self.rank = ranks[-1]
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[self.rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(n - 1, 0), dtype=np.int32)
        for level in range(len(ranks) - 1, -1, -1):  # of the halves, quarters ... that may still agree
            held, size = ranks[level], 1 << level
            same = (a + size <= n) & (b + size <= n)
            same[same] = held[a[same]] == held[b[same]]
            common[same] += size
            a[same] += size
            b[same] += size
        self.minima, size = [common], 1
        while 2 * size <= len(common):
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-size], low[size:]))
            size *= 2

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from x and from y on are the same; x and y differ."""
        a, b = self.rank[x], self.rank[y]
        lo, hi = np.minimum(a, b), np.maximum(a, b)  # the least of common[lo:hi]
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][lo[at]], self.minima[k][hi[at] - (1 << int(k))])
        return out


def grid(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: int, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(x, p): places x of words, x = start of a text + jp, where `places` neighbours of the grid hold the same word, for all
    periods p of which a text holds so many; about room points at once."""
    most = sizes // places
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = np.maximum((sizes[text] - 1) // period - (places - 2), 0)
    ends = np.cumsum(count)
    xs, ps, at = [], [], 0
    while at < len(text):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room)), at + 1)
        c, p = count[at:to], period[at:to]
        j = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        p, x = np.repeat(p, c), np.repeat(starts[text[at:to]], c)
        x = x + j * p
        for k in range(1, places):
            same = words[x] == words[x + k * p]
            x, p = x[same], p[same]
        xs.append(x)
        ps.append(p)
        at = to
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ps])


def runs(texts: list[np.ndarray], min_length: int, min_periods: int) -> list[np.ndarray]:
    """Of each text (ids of its words): rows (start, length, period) of its runs by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([np.zeros(0, dtype=np.int64), *texts])
    x, p = grid(words, starts, sizes, min_periods)
    none = np.zeros((0, 3), dtype=np.int64)
    if not len(x):
        return [none] * len(texts)
    text = np.searchsorted(starts, x, side="right") - 1
    # texts without such a place have no run: the arrays are made of the others, with a mark before each text and at the end
    used = np.unique(text)
    size = sizes[used]
    first = np.cumsum(size + 1) - size
    move = np.zeros(len(sizes), dtype=np.int64)
    move[used] = first - starts[used]
    marks = len(words) + np.arange(len(used) + 1)
    symbols = np.empty(int(size.sum()) + len(used) + 1, dtype=np.int64)
    symbols[np.append(first - 1, len(symbols) - 1)] = marks
    for f, t in zip(first, used, strict=True):
        symbols[f : f + sizes[t]] = texts[t]
    x = x + move[text]
    forward = Extensions(symbols)(x, x + p)
    n = len(symbols)
    backward = Extensions(symbols[::-1])(n - x, n - x - p)  # of the words before both places
    start, length = x - backward - first[np.searchsorted(used, text)], p + forward + backward
    found = np.stack([text, start, length, p], axis=1)[length >= np.maximum(min_length, min_periods * p)]
    found = found[np.lexsort(found.T[::-1])]
    # a stretch of period p is also one of 2p, 3p ...: the smallest is its own
    again = np.zeros(len(found), dtype=bool)
    again[1:] = (found[1:, :3] == found[:-1, :3]).all(axis=1)
    found = found[~again]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    edge = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    return [found[a:b, 1:] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period alone."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def periodic_runs(df: DataFrame, text: str = "text", min_length: int = 6, min_periods: int = 4, prefix: str = "") -> DataFrame:
    """df with n_words (long), runs (start, length, period by start, then period) and collapsed (the words outside of what
    runs repeat, joined by one space), their names after prefix; columns of these names are replaced.

    Words are what stands between ASCII white space. A run is a stretch with smallest period p, of at least min_length words
    and min_periods (2 or more) times p, that no neighbouring word extends. Null and empty texts have no words, no runs and an
    empty collapsed text. Rows are told alone, so repeated rows get the same and an empty table stays empty. Texts are read
    whole; memory is that of 2 MB of texts at once, or of the longest one (some 300 bytes a word where it has runs)."""
    if min_periods < 2:
        raise ValueError("a run repeats at least once")

    read = df.columns.index(text)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighed(batches, read):
            ids: dict[bytes, int] = {}
            words = [raw.split() for raw in raw_texts(batch.column(read))]
            found = runs([np.array([ids.setdefault(w, len(ids)) for w in x], dtype=np.int64) for x in words], min_length, min_periods)
            kept = [b" ".join(compress(x, kept_words(len(x), f)) if len(f) else x) for x, f in zip(words, found, strict=True)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            mine = [pa.array([len(x) for x in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), parts), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in own] + mine, names=[f"c{k}" for k in range(len(own) + 3)])

    made = [prefix + x for x in ("n_words", "runs", "collapsed")]
    own = [k for k, c in enumerate(df.columns) if c not in made]
    kinds = [df.schema[k].dataType for k in own] + [LongType(), RUNS, StringType()]
    return df.mapInArrow(tell, StructType([StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])).toDF(*[df.columns[k] for k in own], *made)


def stretched(words: Column, doc_id: Column) -> Column:
    """The words with a tail that repeats, for documents whose crc32 is divisible by ten: with h that crc32, g = floor(h / 10)
    and n words, each word i from a = g mod n on is the word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8))."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a))

    # an array of one lets the words be found once
    return F.get(F.transform(F.array(words), lambda w: F.when((h % 10 == 0) & (F.size(w) > 0), tail(w)).otherwise(w)), F.lit(0))


def run_digest(docs: DataFrame) -> DataFrame:
    """Of each document (doc_id, text), with its tail `stretched`: doc_id, n_runs, the run of greatest length / period and
    digests of all runs and of the collapsed text. A null doc_id has no crc32 and stretches nothing."""
    text = F.array_join(stretched(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0), F.col("doc_id")), " ")
    # only one in ten is made anew; the others are read as they are
    changed = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    told = periodic_runs(docs.select("doc_id", F.when(changed, text).otherwise(F.col("text")).alias("text")))
    greatest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return told.withColumn("best", greatest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
