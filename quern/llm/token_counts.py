"""Token counts of a BPE vocabulary by rank-synchronous array merging.

Pre-tokens that are not known yet are laid out as one ragged array of symbols. Each round looks up the rank of every
adjacent pair, finds each sequence's lowest with one segmented minimum, and merges that pair wherever it stands in its
sequence, in all sequences at once; sequences without a mergeable pair are done and their symbols counted. A merged
symbol is younger than the pair it came from, so merging all places of the lowest pair gives what a queue gives.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes

_NONE = np.int64(1 << 40)


class PairRanks:
    """rank and result of a pair of symbol ids, by two tables of hashes without collisions."""

    BITS = 20

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> None:
        self.keys, self.ranks, self.results = np.append(pairs, -1), np.append(ranks, _NONE), np.append(results, -1)
        self.tables, left, seed = [], np.arange(len(pairs)), 0x9E3779B97F4A7C15
        while len(left):
            slots = self._slot(pairs[left], seed)
            _, first = np.unique(slots, return_index=True)
            held = np.full(1 << self.BITS, len(pairs), dtype=np.int32)
            held[slots[first]] = left[first]
            self.tables.append((seed, held))
            left = np.delete(left, first)
            seed = (seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64) | 1

    def _slot(self, keys: np.ndarray, seed: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(seed)) >> np.uint64(64 - self.BITS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each pair; the last one where the pair doesn't merge."""
        out = np.full(len(keys), len(self.keys) - 1, dtype=np.int64)
        for seed, held in self.tables:
            i = held[self._slot(keys, seed)]
            out = np.where(self.keys[i] == keys, i, out)
        return out


class WordBpe:
    """Counts tokens as the library gives them for a BPE file with word ends: NFC, white space to one space, lower
    case; apostrophe endings, runs of letters, single digits and runs of anything else; special strings as a token each.
    """

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = sorted((x["content"] for x in spec["added_tokens"] if x["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.base = len(vocab)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        results = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.ranks = PairRanks(pairs, np.arange(len(merges), dtype=np.int64), results)
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)

    def pre_tokens(self, chunk: str) -> tuple[list[bytes], int]:
        """(pre-tokens of text without ASCII white space, number of special strings in it)."""
        parts = [chunk]
        if self.special is not None and "<" in chunk:
            parts = self.special.split(chunk)
        out: list[bytes] = []
        for part in parts:
            text = part if part.isascii() else unicodedata.normalize("NFC", part)
            text = text.lower() if text.isascii() else "".join(map(str.lower, text))
            out += [m.encode() for m in self.pattern.findall(text)]
        return out, len(parts) - 1

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair merges any more."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = lens.copy()
        if not len(words):
            return out
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(lens) - 1
        ids[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lens)  # the pre-token of each symbol
        while len(ids):
            n = len(ids)
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            pair = np.empty(n, dtype=np.int64)
            pair[:-1] = ids[:-1] * self.base + ids[1:]
            pair[-1] = -2
            pair[np.concatenate([start[1:] - 1, [n - 1]])] = -2  # no pair reaches over an end
            at = self.ranks.find(pair)
            rank = self.ranks.ranks[at]
            least = np.minimum.reduceat(rank, start)
            seq = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            hit = (rank == least[seq]) & (rank < _NONE)
            done = least >= _NONE
            if done.any():
                sizes = np.diff(np.append(start, n))
                out[owner[start[done]]] = sizes[done]
            over = hit.copy()
            over[1:] &= hit[:-1]
            if over.any():  # a a a: of overlapping places, each second one from the left
                first = np.maximum.accumulate(np.where(hit & ~over, np.arange(n), 0))
                hit &= (np.arange(n) - first) % 2 == 0
            ids[hit] = self.ranks.results[at[hit]]
            keep = ~done[seq]
            keep[1:] &= ~hit[:-1]
            ids, owner = ids[keep], owner[keep]
        return out


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Counter:
    """Tokens of texts. What stands between ASCII white space is counted once and remembered, up to `room` strings."""

    def __init__(self, path: str, room: int = 1 << 18, batch: int = 1 << 14) -> None:
        self.bpe, self.known, self.room, self.batch = WordBpe(path), {}, room, batch

    def __call__(self, raws: list[bytes]) -> list[int]:
        out = []
        for at in range(0, len(raws), 256):
            split = [r.split() for r in raws[at : at + 256]]
            fresh = {w for words in split for w in words if w not in self.known}
            extra = self._count(list(fresh))
            if len(self.known) < self.room:
                self.known |= {w: n for w, n in extra.items() if len(w) <= 64}
            get = lambda w, a=self.known, b=extra: a[w] if w in a else b[w]
            out += [sum(map(get, words)) for words in split]
        return out

    def _count(self, chunks: list[bytes]) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        for at in range(0, len(chunks), self.batch):
            part = chunks[at : at + self.batch]
            pre, owner, total = [], [], np.zeros(len(part), dtype=np.int64)
            for k, chunk in enumerate(part):
                words, special = self.bpe.pre_tokens(chunk.decode())
                pre += words
                owner += [k] * len(words)
                total[k] = special
            if pre:
                np.add.at(total, owner, self.bpe.counts(pre))
            found.update(zip(part, total.tolist(), strict=True))
        return found


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048, prefix: str = "") -> DataFrame:
    """df with n_bytes, n_tokens (long) and over_limit (n_tokens > limit), their names after prefix.

    vocabulary: path of the BPE file, the same on each machine. Null and empty texts have no bytes and no tokens.
    Repeated rows count alike; an empty table gives an empty one. No text is cut; memory follows the longest one.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary)
        for batch in batches:
            parts = (batch.iloc[at : at + 256] for at in range(0, len(batch), 256))  # few texts as bytes at once
            yield pd.Series([n for part in parts for n in counter(as_bytes(part.tolist()))], dtype="int64")

    made = {prefix + x for x in ("n_bytes", "n_tokens", "over_limit")}
    return df.withColumn("__n", counted(F.col(text))).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in made],
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(prefix + "n_bytes"),
        F.col("__n").alias(prefix + "n_tokens"),
        (F.col("__n") > limit).alias(prefix + "over_limit"),
    )
