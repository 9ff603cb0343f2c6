"""Language-model scores by online logistic context mixing.

A text is its words and an end. Frequent words have codes of bits, short ones for frequent words (Huffman), so a word
is a walk down a tree, a bit at each node; the other words share an escape, after which their own smoothed frequency
tells them apart. Each bit is predicted at its node: by the node's frequency, and in five hashed contexts that cross
words from their counts of zeros and ones: the word before; the two words before; the word before that one; the last two very
frequent words; the word before and the last very frequent one. A logistic mixer adds the predictions in the stretched
domain; which of its weights it takes is gated by how often the contexts of one word and of two have been seen. An
adaptive table, indexed by node and mixed prediction, refines the result.

Beside the bits stands a match model over the whole corpus. Texts are cut into chunks where the hash of two words says so, so
copies are cut alike, and counted by the chunk before. A chunk is then predicted as a whole by what followed that one elsewhere,
and this and the bits are mixed by how often something new followed. The costs of all chunks are the text's total bits.

All is counted over all training words: distributed counts of words and of chunks, which grow with the input,
and tables of contexts, whose size follows the input up to what an executor holds (slot_bits). A task counts many
files into one table, so what is sent stays under the input's size. Weights and the refining table are a classifier of
some thousand numbers; they learn online, bit by bit in order, from all training texts, each task from its own. In a
training text each bit is predicted without its own occurrence, so training texts and held-out ones are scored alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHasher, mix64, raw_texts, sliced, with_row_id, written

CONTEXTS = 5
END = np.uint64(0x3C6EF372FE94F82B)  # stands for the end of a text among hashes of words
_GATES = 16
_BUCKETS = 129  # of the mixed prediction, from -8 to 8
_GROUPS = 256  # of nodes in the refining table: the most frequent ones, and one for the rest
_CHUNK = 1 << 16
_WINDOW = 1 << 12  # words whose bits are laid out at once, few enough for a core's cache
_WORDS = 1 << 10  # of a step of the mixer; a window is some steps
_TURN = np.uint32(2654435761)
LOG2 = float(np.log10(2.0))
_PAIR, _STEP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_START = -1  # stands for the chunk before a text's first one


@dataclass(frozen=True)
class Model:
    """coded: words with a code at most. known: words whose counts each task holds at most; rarer ones are joined.
    slot_bits: size of a context's table at most. task_words: training words that one counting task takes. learn_words:
    about so many of them a task learns mixer and refining table from, and all tasks together from all. anchor: one word of 2 ** anchor, about, ends a chunk. common: so many of the most frequent words are very
    frequent ones. rate: of learning."""

    coded: int = 1 << 16
    known: int = 1 << 20
    slot_bits: int = 22
    task_words: int = 1 << 24
    learn_words: int = 1 << 22
    anchor: int = 5
    common: int = 48
    rate: float = 0.04
    smoothing: float = 0.1
    held_out_of: int = 10


def huffman(weights: list[int]) -> list[tuple[int, int]]:
    """(parent, bit) of each leaf and then of each inner node but the root, the last one; two leaves at least."""
    heap = [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    up: list[tuple[int, int]] = [(-1, 0)] * (2 * len(weights) - 1)
    for k in range(len(weights), 2 * len(weights) - 1):
        w0, a = heapq.heappop(heap)
        w1, b = heapq.heappop(heap)
        up[a], up[b] = (k, 0), (k, 1)
        heapq.heappush(heap, (w0 + w1, k))
    return up[:-1]


class Coder:
    """Known words and their codes. keys: their hashes, ascending; counts: how often they stand in training texts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, m: Model) -> None:
        self.keys, self.counts, self.m = keys, counts, m
        self.starts = np.searchsorted(keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(keys)))
        coded = np.lexsort((keys, -counts))[: m.coded]
        self.escape = len(coded)
        self.coded_words, self.rest = len(coded), total - int(counts[coded].sum())
        self.symbols = np.full(len(keys) + 1, self.escape, dtype=np.int32)  # the last is that of words that aren't known
        self.symbols[coded] = np.arange(len(coded))
        weights = [*counts[coded].tolist(), max(self.rest, 1)]
        weights += [1] * (2 - len(weights))
        self._paths(np.array(huffman(weights), dtype=np.int64).reshape(-1, 2), np.array(weights, dtype=np.float64))

    def _paths(self, up: np.ndarray, weights: np.ndarray) -> None:
        """lengths and firsts by symbol; nodes (0 is the root, frequent ones first), bits and frequency predictions of all walks, one after the other."""
        n = len(weights)
        inner = 2 * n - 2 - np.arange(2 * n - 1)  # inner nodes were made from the least weight to the largest
        total = np.append(weights, np.zeros(n - 1))
        ones = np.zeros(2 * n - 1)
        depth = np.zeros(2 * n - 1, dtype=np.int64)
        parents, bits = up[:, 0], up[:, 1]
        for k in range(2 * n - 2):  # children come before their parents
            total[parents[k]] += total[k]
            if bits[k]:
                ones[parents[k]] = total[k]
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parents[k]] + 1
        self.lengths = depth[:n].copy()
        self.firsts = np.cumsum(self.lengths) - self.lengths
        size = int(self.lengths.sum())
        self.nodes, self.bits, self.often = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.float32)
        now, at = np.arange(n), self.firsts + self.lengths - 1
        while len(now):
            p = parents[now]
            self.nodes[at], self.bits[at] = inner[p], bits[now]
            self.often[at] = np.log(ones[p] / (total[p] - ones[p]))
            going = p != 2 * n - 2
            now, at = p[going], at[going] - 1
        self.turned = (self.nodes.astype(np.uint32) + np.uint32(1)) * np.uint32(0xCC9E2D51)
        self.turned ^= self.turned >> np.uint32(15)
        self.groups = np.minimum(self.nodes, _GROUPS - 1).astype(np.int64) * _BUCKETS

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands in keys; their number for those that don't."""
        out = np.full(len(h), len(self.keys), dtype=np.int64)
        part = (h >> np.uint64(44)).astype(np.int64)
        low, high = self.starts[part].astype(np.int64), self.starts[part + 1].astype(np.int64)
        open_ = np.flatnonzero(low < high)
        at, high, wanted = low[open_], high[open_], h[open_]
        while len(open_):  # a part holds a key or two, so few steps end it
            key = self.keys[at]
            out[open_[key == wanted]] = at[key == wanted]
            at += 1
            more = (key < wanted) & (at < high)
            open_, at, high, wanted = open_[more], at[more], high[more], wanted[more]
        return out

    def read(self, hashes: np.ndarray, bounds: np.ndarray):
        """(words with ends, places in keys, symbols, contexts, first word of each text) of texts whose words lie one after the other."""
        words = np.insert(hashes, bounds[1:], END)
        first = bounds[:-1] + np.arange(len(bounds) - 1)
        at = self.find(words)
        symbols = self.symbols[at]
        own = np.repeat(first, np.diff(np.append(first, len(words))))  # each word's text's first word
        place = np.arange(len(words))
        short = (words ^ words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never 0, which stands for no word
        padded = np.concatenate([np.zeros(3, dtype=np.uint32), short])
        one = np.where(place - 1 >= own, padded[2 : 2 + len(words)], np.uint32(0))
        two = np.where(place - 2 >= own, padded[1 : 1 + len(words)], np.uint32(0))
        last = np.maximum.accumulate(np.where(symbols < min(self.m.common, self.escape), place, -1))
        last = np.append(-1, last[:-1])  # before the word
        last = np.where(last >= own, last, -1)
        before = np.where(last >= 0, last[last], -1)
        near, far = (np.where(x >= 0, short[x], np.uint32(0)) for x in (last, before))
        c = np.uint32
        contexts = np.stack([
            one * c(0x9E3779B1) + c(1), (one * c(0x85EBCA6B) ^ two * c(0xC2B2AE35)) + c(2), two * c(0x27D4EB2F) + c(3), (near * c(0x165667B1) ^ far * c(0xD3A2646D)) + c(4), (one * c(0xFD7046C5) ^ near * c(0xB55A4F09)) + c(5),
        ])
        return words, at, symbols, contexts ^ contexts >> np.uint32(16), first

    def walks(self, symbols: np.ndarray, contexts: np.ndarray, slot_bits: int):
        """By windows: (window, lengths, places in the walks, slots of each context) of the bits of words."""
        shift = np.uint32(32 - slot_bits)
        for a in range(0, len(symbols), _WINDOW):
            s = symbols[a : a + _WINDOW]
            lens = self.lengths[s]
            flat = np.repeat(self.firsts[s] - (np.cumsum(lens) - lens), lens)
            flat += np.arange(len(flat))
            turned = self.turned.take(flat, mode="clip")

            def slots(k: int, a=a, lens=lens, turned=turned) -> np.ndarray:
                x = np.repeat(contexts[k, a : a + _WINDOW], lens)
                x ^= turned
                x *= _TURN
                x >>= shift
                return x.astype(np.intp)

            yield a, lens, flat, slots


#: What a byte says of a count: up to 64 the count itself, then steps of an eighth or so, up to 2^40.
_COUNTED = np.concatenate([np.arange(65), np.round(64 * 2.0 ** (34 * np.arange(1, 192) / 191))])
_MIDDLES = (_COUNTED[1:] + _COUNTED[:-1]) / 2


def _stretches() -> tuple[np.ndarray, np.ndarray]:
    """(stretched prediction, how often seen in four levels) of a pair of counts (bytes of zeros + 256 * those of ones), as it
    is, without one of its zeros, without one of its ones."""
    zeros, ones = _COUNTED[np.arange(65536) & 255], _COUNTED[np.arange(65536) >> 8]
    out, levels = [], []
    for z, o in ((zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))):
        out.append(np.log((o + 0.4) / (z + 0.4)).astype(np.float32))
        levels.append(np.searchsorted([1, 3, 24], z + o, side="right").astype(np.int8))
    return np.concatenate(out), np.concatenate(levels)


_STRETCH, _LEVEL = _stretches()


@dataclass
class Trained:
    """tables: pairs of counts of each context's slots; weights by input (contexts, frequency, one) and gate; costs: bits that a zero and a one cost, by refining cell."""

    coder: Coder
    tables: np.ndarray
    weights: np.ndarray
    costs: np.ndarray
    slot_bits: int

    def inputs(self, lens: np.ndarray, flat: np.ndarray, slots, training: np.ndarray | None = None):
        """(predictions of each context, gate, bits) of bits; training: for each word, whether it was learnt from; none: all were."""
        bit = self.coder.bits.take(flat, mode="clip")
        mode = bit + np.intp(1)
        if training is not None:
            mode *= np.repeat(training.astype(np.intp), lens)
        mode <<= 16
        told, levels = [], []
        for k in range(CONTEXTS):
            seen = self.tables[k].take(slots(k), mode="clip") + mode
            told.append(_STRETCH.take(seen, mode="clip"))
            if k < 2:
                levels.append(_LEVEL.take(seen, mode="clip"))
        return told, (levels[1] * np.int8(4) + levels[0]).astype(np.intp), bit

    def mixed(self, told: list[np.ndarray], gate: np.ndarray, often: np.ndarray) -> np.ndarray:
        w = self.weights
        x = w[CONTEXTS].take(gate, mode="clip")
        x *= often
        x += w[CONTEXTS + 1].take(gate, mode="clip")
        for k in range(CONTEXTS):
            part = w[k].take(gate, mode="clip")
            part *= told[k]
            x += part
        return np.clip(x, np.float32(-8.0), np.float32(8.0), out=x)

    def cells(self, x: np.ndarray, flat: np.ndarray) -> np.ndarray:
        out = (x * np.float32(8.0) + np.float32(64.5)).astype(np.intp)
        out += self.coder.groups.take(flat, mode="clip")
        return out

    def word_bits(self, symbols: np.ndarray, contexts: np.ndarray, training: np.ndarray) -> np.ndarray:
        """What the code of each word costs."""
        out = np.empty(len(symbols))
        for a, lens, flat, slots in self.coder.walks(symbols, contexts, self.slot_bits):
            told, gate, bit = self.inputs(lens, flat, slots, training[a : a + _WINDOW])
            cell = self.cells(self.mixed(told, gate, self.coder.often.take(flat, mode="clip")), flat)
            cell <<= 1
            cell += bit
            cost = self.costs.take(cell, mode="clip")
            out[a : a + _WINDOW] = np.add.reduceat(cost, np.cumsum(lens) - lens)
        return out


def _hashed(batches: Iterator[pa.RecordBatch], hasher: WordHasher):
    """(batch, index of the first text, word hashes, bounds) by slices of texts."""
    for batch in sliced(batches, 2048):
        for at, h, bounds in hasher(raw_texts(batch.column("text"))):
            yield batch, at, h, bounds


def count_words(docs: DataFrame) -> DataFrame:
    """h (a word's hash), c of texts; each text has one end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ends = [], 0, 0

        def told() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([*held, np.full(ends, END)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for _, _, h, bounds in _hashed(batches, WordHasher()):
            held.append(h)
            n, ends = n + len(h), ends + len(bounds) - 1
            if n > 1 << 22:
                yield told()
                held, n, ends = [], 0, 0
        if ends:
            yield told()

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def chunks(words: np.ndarray, first: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each chunk, its hash, chunks of each text) of texts whose words lie one after the other; first: of each text. A
    chunk ends with a word whose hash, with that of the word before it in the text, has `anchor` zeros, or with its text."""
    before = np.append(np.zeros(1, dtype=np.uint64), words[:-1])
    before[first] = 0
    ends = mix64(words * _PAIR + before) >> np.uint64(64 - anchor) == 0
    opens = np.append(True, ends[:-1])
    opens[first] = True
    at = np.flatnonzero(opens)
    before[at] = 0
    value = mix64(np.add.reduceat(mix64(words + before * _STEP), at)).view(np.int64)
    value[value == _START] = 0
    return at, value, np.add.reduceat(opens.astype(np.int64), first)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each; after them the places and values of those of 255 and more."""
    big = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + big.astype(np.int64).tobytes() + counts[big].astype(np.int64).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    big = np.frombuffer(raw, dtype=np.int64, offset=n) if len(raw) > n else np.zeros(0, dtype=np.int64)
    out[big[: len(big) // 2]] = big[len(big) // 2 :]
    return out


def _paired(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as a byte each, each count by itself: 1 against a million stays that."""
    small = np.searchsorted(_MIDDLES, counts, side="left").astype(np.uint16)
    return small[:, 0] | small[:, 1] << np.uint16(8)


def context_tables(docs: DataFrame, coder, slot_bits: int, tasks: int) -> np.ndarray:
    """Pairs of counts by context and slot, over all texts: tables of fixed size. Tasks send whole counts; the sums alone are
    put in a byte each. coder: broadcast."""
    size = CONTEXTS << slot_bits
    width = min(_CHUNK, 1 << slot_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((CONTEXTS, 2 << slot_bits), dtype=np.uint32)
        for _, _, h, bounds in _hashed(batches, WordHasher()):
            _, _, symbols, contexts, _ = coder.value.read(h, bounds)
            for _, _, flat, slots in coder.value.walks(symbols, contexts, slot_bits):
                bit = coder.value.bits.take(flat, mode="clip")
                for k in range(CONTEXTS):
                    x = slots(k)
                    x <<= 1
                    x |= bit
                    np.add.at(tables[k], x, np.uint32(1))
        parts = tables.reshape(-1, 2 * width)
        for k in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(parts[k])], pa.binary())], names=["chunk", "counts"])

    def total(pdf: pd.DataFrame) -> np.ndarray:
        return sum((_unpacked(b, 2 * width) for b in pdf["counts"]), np.zeros(2 * width, dtype=np.int64))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [_packed(total(pdf))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [_paired(total(pdf).reshape(-1, 2)).tobytes()]})

    parts = docs.select("text").coalesce(tasks).mapInArrow(count, "chunk int, counts binary")
    if tasks > 64:  # first by parts, so that no task gets a chunk of all of them
        parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(int(tasks**0.5)))).groupBy("chunk", "part").applyInPandas(add, "chunk int, counts binary")
    out = np.zeros((size // width, width), dtype=np.uint16)
    for row in written(parts.groupBy("chunk").applyInPandas(last, "chunk int, counts binary")).toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.uint16)
    return out.reshape(CONTEXTS, -1)


def _start() -> np.ndarray:
    out = np.full((CONTEXTS + 2, _GATES), 0.25, dtype=np.float32)
    out[CONTEXTS] = 0.4
    out[CONTEXTS + 1] = 0.0
    return out


def learn(model: Trained, symbols: np.ndarray, contexts: np.ndarray, rate: float, saw: np.ndarray, hits: np.ndarray) -> None:
    """Online steps of the weights, of _WORDS words each, over words in order; counts what the refining table needs. What no weight
    changes is told for a window of many steps at once."""
    for _, lens, flat, slots in model.coder.walks(symbols, contexts, model.slot_bits):
        told, gates, bits = model.inputs(lens, flat, slots)
        frequent = model.coder.often.take(flat, mode="clip")
        mixed = np.empty_like(frequent)
        ends = np.cumsum(lens)
        at = 0
        for end in [*ends[_WORDS - 1 : -1 : _WORDS].tolist(), len(flat)]:
            part = slice(at, end)
            now, gate, often = [x[part] for x in told], gates[part], frequent[part]
            x = mixed[part] = model.mixed(now, gate, often)
            off = bits[part] - 1.0 / (1.0 + np.exp(-x))
            times = np.bincount(gate, minlength=_GATES)
            each = rate / np.maximum(times, 64)
            for k, s in enumerate([*now, often]):
                model.weights[k] += (each * np.bincount(gate, off * s, _GATES)).astype(np.float32)
            model.weights[CONTEXTS + 1] += (each * np.bincount(gate, off, _GATES)).astype(np.float32)
            saw += times
            at = end
        cells = model.cells(mixed, flat)
        cells <<= 1
        cells += bits
        hits += np.bincount(cells, minlength=len(hits))


def _mixer(docs: DataFrame, shared, m: Model, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refined): each task learns online from the same start; then weights are averaged by the bits they saw and
    the refining counts summed. shared: the model, broadcast, its weights at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        model = Trained(told.coder, told.tables, _start(), told.costs, told.slot_bits)
        saw, hits = np.zeros(_GATES, dtype=np.int64), np.zeros(2 * _GROUPS * _BUCKETS, dtype=np.int64)
        for _, _, h, bounds in _hashed(batches, WordHasher()):
            _, _, symbols, contexts, _ = model.coder.read(h, bounds)
            learn(model, symbols, contexts, m.rate, saw, hits)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights * saw.astype(np.float64), saw, hits)], names=["weights", "saw", "hits"])

    sums, saw, hits = _start() * 1e-9, np.full(_GATES, 1e-9), np.zeros((_GROUPS * _BUCKETS, 2))
    learnt = written(docs.select("text").coalesce(tasks).mapInArrow(run, "weights binary, saw binary, hits binary"))  # an iterator over the tasks themselves would run one after the other
    for row in learnt.toLocalIterator():
        sums, saw, hits = sums + np.frombuffer(row["weights"]).reshape(sums.shape), saw + np.frombuffer(row["saw"], dtype=np.int64), hits + np.frombuffer(row["hits"], dtype=np.int64).reshape(hits.shape)
    prior = np.tile(1.0 / (1.0 + np.exp(-(np.arange(_BUCKETS) - 64.0) / 8.0)), _GROUPS)
    return (sums / saw).astype(np.float32), (hits[:, 1] + 24.0 * prior) / (hits.sum(axis=1) + 24.0)


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts: all with a count at least as high as the lowest bound that leaves `most` or fewer."""
    powers = table.groupBy(F.floor(F.log2("c") * 8).alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect()  # a few hundred at most
    total, bound = 0, None
    for row in powers:
        total += row["n"]
        if total > most:
            break
        bound = row["p"]
    return table.filter(F.floor(F.log2("c") * 8) >= bound) if bound is not None else table.limit(0)


def train(docs: DataFrame, words: DataFrame, total: int, m: Model) -> Trained:
    """The model of training texts and their counted words (h, c), a written table; total: of the words."""
    told = _frequent(words, m.known).toArrow()
    keys, counts = told.column("h").to_numpy().view(np.uint64), told.column("c").to_numpy()
    order = np.argsort(keys)
    coder = Coder(keys[order], counts[order], total, m)
    slot_bits = min(m.slot_bits, max(10, total.bit_length()))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(coder)
    tables = context_tables(docs, shared, slot_bits, max(1, -(-total // m.task_words)))
    shared.destroy()
    model = Trained(coder, tables, _start(), np.zeros(0), slot_bits)
    shared = sc.broadcast(model)
    model.weights, refined = _mixer(docs, shared, m, max(6, -(-total // m.learn_words)))
    shared.destroy()
    model.costs = -np.log2(np.stack([1.0 - refined, refined], axis=1)).ravel()
    return model


def lm_scores(df: DataFrame, text: str = "text", id: str = "doc_id", params: Model | None = None) -> DataFrame:  # noqa: A002
    """id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (log10 probabilities), total_bits, bits_per_byte.

    The model learns from rows whose crc32(id as text) mod 10 is not 0 (a null id counts as an empty text and is held
    out) and scores all. Tokens: words without white space, A-Z lower-cased, then one end; words are known by 64-bit
    hashes. Null and empty texts are one end. A very long text is scored whole, its bits window by window. Repeated rows
    are learnt from and scored each. Without training rows all counts are 0. An empty table gives an empty one; other
    columns are not returned. base_score: the words' own smoothed frequencies. bits_per_byte: over the words with one
    byte after each, and the end.
    """
    m = params or Model()
    spark = df.sparkSession
    held_out = F.pmod(F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))), F.lit(m.held_out_of)) == 0
    docs = df.select(F.col(f"`{id}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text}`").alias("text"))
    learnt = docs.filter(~F.col("held_out"))
    words = written(count_words(learnt))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    trained = train(learnt, words, total["n"], m)
    below = float(np.log10(total["n"] + m.smoothing * (total["v"] + 1))) if total["n"] else 0.0
    rest = trained.coder.rest + m.smoothing * (total["v"] - trained.coder.coded_words + 1)
    below_escape = float(np.log10(rest))
    model = spark.sparkContext.broadcast(trained)
    kinds = pa.schema([("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64())])
    lists = pa.schema([("rare", pa.list_(pa.int64())), ("rare_chunk", pa.list_(pa.int32())), ("chunk", pa.list_(pa.int64())), ("chunk_bits", pa.list_(pa.float32()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = model.value
        coder = told.coder
        logs = np.append(np.log10(coder.counts + m.smoothing), 0.0)
        for batch, first_text, h, bounds in _hashed(batches, WordHasher(sizes=True)):
            h, sizes = h
            n = len(bounds) - 1
            own = batch.select(["id", "held_out"]).slice(first_text, n)
            words, at, symbols, contexts, first = coder.read(h, bounds)
            lens = np.diff(np.append(first, len(words)))
            learnt = np.repeat(~own.column("held_out").to_numpy(zero_copy_only=False), lens).astype(np.int32)
            known = at < len(coder.keys)
            escaped = (symbols == coder.escape) & known
            bits = told.word_bits(symbols, contexts, learnt) - np.where(escaped, logs[at] - below_escape, 0.0) / LOG2
            begins, value, many = chunks(words, first, m.anchor)
            place = np.arange(len(begins)) - np.repeat(np.cumsum(many) - many, many)  # of each chunk in its text
            rare = np.flatnonzero(~known)
            sums = lambda x, first=first: np.add.reduceat(x, first)
            n_bytes = np.add.reduceat(np.append(sizes, 0), np.minimum(bounds[:-1], len(sizes))) * (np.diff(bounds) > 0) + lens
            made = (lens, n_bytes, sums(known.astype(np.int64)), sums(np.where(known, logs[at] - below, 0.0)), sums(bits))
            arrays = [pa.array(x, f.type) for x, f in zip(made, kinds, strict=True)]
            ends = [np.append(0, np.cumsum(x)).astype(np.int32) for x in (sums((~known).astype(np.int64)), many)]
            owner = np.searchsorted(begins, rare, side="right") - 1
            flat = (words[rare].view(np.int64), place[owner].astype(np.int32), value, np.add.reduceat(bits, begins).astype(np.float32))
            arrays += [pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in zip((ends[0], ends[0], ends[1], ends[1]), flat, strict=True)]
            yield pa.RecordBatch.from_arrays([*own.columns, *arrays], schema=pa.schema([*own.schema, *kinds, *lists]))

    kind = docs.schema["id"].dataType.simpleString()
    scored = docs.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, bits double, rare array<long>, rare_chunk array<int>, chunk array<long>, chunk_bits array<float>")
    scored = written(with_row_id(scored, "row"))
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("rare_chunk").alias("k"))).alias("x")).groupBy("row", "x.k", "x.h").agg(F.count("*").alias("times"))
    found = F.coalesce("c", F.lit(0))
    log = F.log10(found + m.smoothing)
    more = rare.join(words, "h", "left").groupBy("row", "k").agg(
        F.sum(F.col("times") * (log - below)).alias("base_more"), (F.sum(F.col("times") * (below_escape - log)) / LOG2).alias("bits_more"), F.sum(F.when(found > 0, F.col("times")).otherwise(0)).alias("found")
    )
    more = written(more)
    every = more.select("row", "base_more", "bits_more", "found").unionByName(_matched(scored, more), allowMissingColumns=True)
    every = every.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("base_more", "bits_more", "found")])
    out = scored.drop("rare", "rare_chunk", "chunk", "chunk_bits").join(every, "row", "left")
    bits = F.col("bits") + F.coalesce("bits_more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), (-bits * LOG2).alias("score"), bits.alias("total_bits"), (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _matched(scored: DataFrame, more: DataFrame) -> DataFrame:
    """row, bits_more: what the match model adds to (mostly takes from) the bits of each chunk of which the one before stands
    elsewhere. scored: row, held_out, chunk and chunk_bits, arrays; more: row, k, bits_more of words that these leave out.

    Of a chunk's own occurrence nothing is counted. With n followers elsewhere of the chunk before, d of them different and c like this
    one, its probability is n / (n + d) * c / n + d / (n + d) * 2 ** -bits."""
    x = F.posexplode(F.arrays_zip("chunk", "chunk_bits")).alias("k", "x")
    all_ = scored.select("row", "held_out", "chunk", x)
    each = all_.select("row", F.when(F.col("held_out"), 0).otherwise(1).alias("own"), "k", F.when(F.col("k") == 0, F.lit(_START).cast("long")).otherwise(F.get("chunk", F.col("k") - 1)).alias("before"), F.col("x.chunk").alias("chunk"), F.col("x.chunk_bits").cast("double").alias("bits"))
    moves = written(each.filter("own = 1").groupBy("before", "chunk").agg(F.count("*").alias("c")))
    sums = F.sum("c").alias("n"), F.count("*").alias("d")
    first = moves.filter(F.col("before") == _START).agg(*sums).first()  # each text begins after the same one: no join for that
    left = written(moves.filter(F.col("before") != _START).groupBy("before").agg(*sums))
    told = each.filter("k > 0").join(left, "before").filter("n > own")
    begin = each.filter("k = 0").withColumns({"n": F.lit(first["n"] or 0).cast("long"), "d": F.lit(first["d"]).cast("long")}).filter("n > own")
    told = told.unionByName(begin).join(moves, ["before", "chunk"], "left")
    told = told.select("row", "k", "bits", (F.col("n") - F.col("own")).alias("n"), (F.coalesce("c", F.lit(0)) - F.col("own")).alias("c"), (F.col("d") - F.when(F.col("c") == F.col("own"), 1).otherwise(0)).alias("d"))
    new = told.filter("c = 0").select("row", F.log2(F.greatest(F.col("d"), F.lit(1)) / (F.col("n") + F.greatest(F.col("d"), F.lit(1)))).alias("gain"))
    seen = told.filter("c > 0").join(more.select("row", "k", F.col("bits_more").alias("rest")), ["row", "k"], "left").withColumn("bits", F.col("bits") + F.coalesce("rest", F.lit(0.0)))
    p = F.col("c") / (F.col("n") + F.col("d")) + F.col("d") / (F.col("n") + F.col("d")) * F.pow(F.lit(2.0), -F.col("bits"))
    seen = seen.select("row", (F.col("bits") + F.log2(p)).alias("gain"))
    return new.unionByName(seen).select("row", (-F.col("gain")).alias("bits_more"))
