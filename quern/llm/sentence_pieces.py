"""Encoding and decoding with a sentencepiece BPE model; every piece knows the bytes of the text it stands for.

A text is normalised by the longest prefix that the model's compiled character map knows; each character of the result keeps
the byte of the text it came from. No piece has a word mark inside, so the result is cut before each run of marks and every
stretch is merged alone, best piece first (new ones all at once, as arrays), and remembered. Piece lengths then give the spans by one sum over the text.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.llm.common import sliced, weighed
from quern.llm.token_counts import PairRanks

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_LAST = 1 << 20  # rank of pairs that make no piece
_STRETCH = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


def charmap(blob: bytes) -> dict[str, str]:
    """Replacement of each string of a compiled character map: a double array of 32-bit units, then strings closed by a zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings, out = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist(), blob[4 + size :], {}
    reach = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
    below = [(reach(0), b"")]
    while below:
        base, key = below.pop()
        for c in range(1, 256):
            at = base ^ c
            if at < len(units) and units[at] & 0x800000FF == c:
                to = reach(at)
                if units[at] & 256:
                    value = units[to] & 0x7FFFFFFF
                    out[(key + bytes([c])).decode()] = strings[value : strings.index(b"\0", value)].decode()
                below.append((to, key + bytes([c])))
    return out


class Model:
    """Pieces, scores and normalisation of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            spec = list(fields(f.read()))
        part = lambda n: dict(x for k, v in spec if k == n for x in fields(v))
        trainer, rules = part(2), part(3)
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or part(5).get(2):
            raise ValueError("a BPE model with word marks in front and no map for decoding is needed")
        self.pieces, self.kinds, self.ids, self.costs = [], [], {}, {}
        for n, (number, value) in enumerate(x for x in spec if x[0] == 1):
            piece = dict(fields(value))
            word, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) or SPACE in word.lstrip(SPACE):
                raise ValueError(f"piece {word!r} is of a kind that is not supported")
            self.pieces.append(word)
            self.kinds.append(kind)
            if kind == NORMAL:
                self.ids[word] = n
                self.costs[word] = -struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        # symbols: pieces, then characters. A pair of symbols that spell a piece ranks by its cost
        self.base, normal = len(self.pieces), self.ids
        self.chars = np.array([*map(len, self.pieces)], dtype=np.int64)
        self.symbol = self.base + np.arange(0x110000, dtype=np.int64)
        single = [p for p in normal if len(p) == 1]
        self.symbol[[ord(p) for p in single]] = [normal[p] for p in single]
        of = lambda p: int(self.symbol[ord(p)]) if len(p) == 1 else normal.get(p)
        ranks = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        pairs = [(x * (self.base + 0x110000) + y, ranks[self.costs[p]], n) for p, n in normal.items() for k in range(1, len(p)) if (x := of(p[:k])) is not None and (y := of(p[k:])) is not None]
        self.pairs = PairRanks(*(np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))) if pairs else PairRanks(*[np.zeros(0, dtype=np.int64)] * 3)
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.bytes_ = {int(p[1:-1], 16): n for n, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE} if trainer.get(35) else {}
        self.byte_ids = np.array([self.bytes_.get(b, 0) for b in range(256)], dtype=np.int64)
        self._rules(rules)

    def _rules(self, rules: dict[int, int | bytes]) -> None:
        self.map = charmap(rules.get(2, b""))
        self.dummy, self.trim, self.escape = (rules.get(k, 1) for k in (3, 4, 5))
        self._first = regex.compile("[" + regex.escape("".join({k[0] for k in self.map})) + "]") if self.map else None
        self._longest = max(map(len, self.map), default=0)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, for each of its characters and for its end the byte of the text it comes from)."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        origin = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each character of the text
        if self._first is not None:
            text, origin = self._mapped(text, origin)
        if self.trim:
            text, origin = _single_spaces(text, origin)
        if not text:
            return "", origin[:1]
        mark = SPACE if self.escape else " "
        text = text.replace(" ", mark)
        if self.dummy:
            return mark + text, np.concatenate([origin[:1], origin])
        return text, origin

    def _mapped(self, text: str, origin: np.ndarray) -> tuple[str, np.ndarray]:
        out, froms, at = [], [], 0
        for m in self._first.finditer(text):
            i = m.start()
            if i < at:
                continue
            for size in range(min(self._longest, len(text) - i), 0, -1):
                new = self.map.get(text[i : i + size])
                if new is not None:
                    out += [text[at:i], new]
                    froms += [origin[at:i], np.repeat(origin[i], len(new))]
                    at = i + size
                    break
        return "".join(out) + text[at:], np.concatenate([*froms, origin[at:]])

    def merged(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left of all stretches when no two neighbours make a piece any more, how many each has). A symbol is a piece, or
        `base` and the code of a character that is none.

        In each stretch of all pairs the one of best score goes first, of equal ones the first from the left. Stretches of up to
        64 characters are one ragged array of symbols with the rank of the pair that each begins: a round merges one pair in
        every stretch that has any and looks up the two pairs beside it."""
        lens = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        long = np.flatnonzero(lens > 64)
        ids = self.symbol[np.frombuffer("".join(s for s in stretches if len(s) <= 64).encode("utf-32-le"), dtype=np.uint32)]
        owner = np.repeat(np.arange(len(stretches)), np.where(lens > 64, 0, lens))
        done_ids, done_owner = [], []
        rank, made = self._pairs(ids[:-1], ids[1:]) if len(ids) else (ids, ids)
        rank, made = np.append(rank, _LAST)[: len(ids)], np.append(made, -1)[: len(ids)]
        rank[:-1][owner[1:] != owner[:-1]] = _LAST  # no pair reaches over an end
        while len(ids):
            n = len(ids)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank * n + np.arange(n), first)  # the leftmost of the best
            live = least < _LAST * n
            stays = np.repeat(live, np.diff(np.append(first, n)))
            if not live.all():
                done_ids.append(ids[~stays])
                done_owner.append(owner[~stays])
            at = least[live] % n
            ids[at] = made[at]
            stays[at + 1] = False
            new = np.cumsum(stays)[at] - 1
            ids, owner, rank, made = ids[stays], owner[stays], rank[stays], made[stays]
            right = new[(new + 1 < len(ids)) & (owner[np.minimum(new + 1, len(ids) - 1)] == owner[new])] if len(ids) else new
            rank[new] = _LAST
            rank[right], made[right] = self._pairs(ids[right], ids[right + 1])
            left = new[(new > 0) & (owner[new - 1] == owner[new])] if len(ids) else new
            rank[left - 1], made[left - 1] = self._pairs(ids[left - 1], ids[left])
        for k in long.tolist():
            parts = self._merged_by_queue(list(stretches[k]))
            done_ids.append(np.array([self.ids.get(p, -1) if len(p) > 1 else self.symbol[ord(p)] for p in parts], dtype=np.int64))
            done_owner.append(np.full(len(parts), k))
        none = np.zeros(0, dtype=np.int64)
        ids, owner = np.concatenate([none, *done_ids]), np.concatenate([none, *done_owner])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(stretches))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols."""
        at = self.pairs.find(a * (self.base + 0x110000) + b)
        return np.minimum(self.pairs.ranks[at], _LAST), self.pairs.results[at]

    def _merged_by_queue(self, parts: list[str | None]) -> list[str]:
        """The same for long stretches, in time that grows little faster than they do."""
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (word := parts[a] + parts[b]) in self.costs:
                heapq.heappush(heap, (self.costs[word], a, b, word))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, word = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != word:
                continue
            parts[a], parts[b] = word, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def encoded(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each stretch; of all pieces: id, characters, whether it is a byte of an unknown character and not its last)."""
        symbols, counts = self.merged(stretches)
        code = symbols - self.base
        strange = code >= 0
        if not strange.any():
            return counts, symbols, self.chars[symbols], np.zeros(len(symbols), dtype=bool)
        width = np.where(strange & bool(self.bytes_), 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        at = np.repeat(np.arange(len(symbols)), width)
        place = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
        last = place == width[at] - 1
        ids = np.where(strange, self.unknown, symbols)[at]
        if self.bytes_:
            w, c, odd = width[at], code[at], strange[at]
            lead = np.where(w == 1, c, ((0xF00 >> w) & 0xFF) | (c >> (6 * (w - 1))))
            byte = np.where(place == 0, lead, 0x80 | ((c >> (6 * (w - 1 - place))) & 0x3F))
            ids[odd] = self.byte_ids[byte[odd]]
        chars = np.where(strange, 1, self.chars[np.where(strange, 0, symbols)])[at]
        ends = np.cumsum(width)[np.cumsum(counts) - 1] if len(counts) else counts
        return np.diff(np.concatenate([[0], ends])), ids, np.where(last, chars, 0), ~last


def _single_spaces(text: str, origin: np.ndarray) -> tuple[str, np.ndarray]:
    """Without spaces at both ends and behind another space; the end comes from the first space that is left out there."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    space = points == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    last = np.flatnonzero(~space)
    if not len(last):
        return "", origin[:1]
    keep[last[-1] + 1 :] = False
    end = origin[last[-1] + 1]
    return points[keep].tobytes().decode("utf-32-le"), np.append(origin[:-1][keep], end)


class Encoder:
    """Ids and spans of texts, many at once. Stretches of up to 64 characters are remembered until `room` pieces are."""

    def __init__(self, model: Model, room: int = 1 << 20) -> None:
        self.model, self.room, self.known = model, room, {}
        self.held = [np.zeros(1, dtype=np.int64), *(np.zeros(0, dtype=k) for k in (np.int32, np.int16, bool))]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends of the texts in what follows, id, first byte, byte after the last one of each piece)."""
        places, sizes, origins = [], [], []
        fresh: dict[str, int] = {}
        get, at = self.known.get, len(self.held[0]) - 1
        for text in texts:
            clean, origin = self.model.normalise(text)
            before = len(places)
            for s in _STRETCH.findall(clean):
                k = get(s)
                places.append(fresh.setdefault(s, at + len(fresh)) if k is None else k)
            sizes.append(len(places) - before)
            origins.append(origin)
        counts, *parts = self.model.encoded([*fresh])
        starts = np.concatenate([self.held[0], self.held[0][-1] + np.cumsum(counts)])
        ids, chars, inner = (np.concatenate([x, y.astype(x.dtype)]) for x, y in zip(self.held[1:], parts, strict=True))
        if len(ids) <= self.room:
            self.held = [starts, ids, chars, inner]
            self.known |= fresh
        at = np.array(places, dtype=np.int64)
        count = starts[at + 1] - starts[at]
        total = np.cumsum(count)
        flat = np.arange(int(count.sum())) + np.repeat(starts[at] - (total - count), count)
        text_of = np.cumsum([0, *sizes])
        ends = np.concatenate([[0], total])[text_of]
        ids, chars, inner = ids[flat], chars[flat], inner[flat]
        # characters before each piece, over all texts: each text has one entry more than characters, its end
        shift = np.repeat(np.arange(len(texts)), np.diff(ends))
        until = np.cumsum(chars) + shift
        origin = np.concatenate([np.zeros(0, dtype=np.int64), *origins])
        begin = origin[until - chars]
        end = origin[until]
        return ends, ids, begin, np.where(inner, begin, end)


class Decoder:
    """Texts of ids, whatever their order: each byte that is part of no character becomes U+FFFD."""

    def __init__(self, model: Model) -> None:
        text = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: model.unknown_text}
        self.texts = [text[k](p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.marked = [k == NORMAL and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.lead, self.all = model.dummy or model.trim, model.trim
        codecs.register_error("quern-bytes", lambda e: ("�" * (e.end - e.start), e.end))

    def __call__(self, ids: list[int]) -> str:
        texts, at = [*map(self.texts.__getitem__, ids)], 0
        while self.lead and at < len(ids):
            if texts[at] and not self.marked[ids[at]]:
                break
            if texts[at]:
                texts[at] = texts[at][1:]
                if texts[at] or not self.all:
                    break
            at += 1
        return b"".join(texts).decode("utf-8", "quern-bytes")


def sentencepiece_encode(df: DataFrame, model: str, text: str = "text", prefix: str = "") -> DataFrame:
    """df with ids, begins and ends (arrays of int, one entry a piece), their names after prefix; columns of these names are
    replaced. Piece k stands for the bytes begins[k] to ends[k] of the UTF-8 text: a mark in front for none, the bytes of an
    unknown character for none but the last, which has all of them.

    model: path of a BPE model file, the same on each machine; ids are those of the library without begin, end and sampling.
    Null and empty texts have no pieces. Rows are told alone: repeated ones get the same, an empty table stays empty. Texts are
    read whole; memory follows a few of them, or the longest one."""
    made = [prefix + x for x in ("ids", "begins", "ends")]
    own = [k for k, c in enumerate(df.columns) if c not in made]
    read = df.columns.index(text)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(model))
        for batch in weighed(batches, read):
            ends, *parts = encoder([t or "" for t in batch.column(read).to_pylist()])
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(p.astype(np.int32))) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in own] + lists, names=[f"c{k}" for k in range(len(own) + 3)])

    kinds = [df.schema[k].dataType for k in own] + [ArrayType(IntegerType())] * 3
    return df.mapInArrow(tell, StructType([StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])).toDF(*[df.columns[k] for k in own], *made)


def sentencepiece_decode(df: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null ids give null, no ids the empty text, an id that the model has not is an error."""

    own = [k for k, c in enumerate(df.columns) if c != to]
    read = df.columns.index(ids)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Model(model))
        for batch in sliced(batches, 256):
            lists = batch.column(read)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decoder(flat[a:b].tolist()) if valid else None for a, b, valid in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in own] + [pa.array(texts, pa.string())], names=[f"c{k}" for k in range(len(own) + 1)])

    return df.mapInArrow(tell, StructType([StructField(f"c{k}", df.schema[i].dataType) for k, i in enumerate(own)]).add(f"c{len(own)}", "string")).toDF(*[df.columns[k] for k in own], to)
