"""Quality rules: compression bands.

Repetitive text compresses far better than prose and random text hardly at all, so two zstandard ratios judge a
document: that of the whole text, and those of its fixed chunks. The limits depend on the length, because the
ratio of a short text is mostly frame overhead. Word rules (too few words, too many repeated 8-word windows) come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHasher, as_bytes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """bands: (bytes from, lowest and highest ratio raw/compressed of the whole text), by length.
    chunk: bytes of a fixed chunk, the last one ending with the text; a text is also rejected where more than chunk_share of its chunks have a
    ratio over chunk_high (repetitive) or under chunk_low (incompressible)."""

    bands: tuple[tuple[int, float, float], ...] = ((0, 0.0, 4.5), (256, 1.08, 6.0), (2048, 1.2, 8.0), (16384, 1.3, 11.0))
    chunk: int = 4096
    chunk_low: float = 1.1
    chunk_high: float = 9.0
    chunk_share: float = 0.5
    min_words: int = 20
    max_repeat_pct: int = 30
    level: int = 3


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, bad_chunk_share double, band_failed boolean, kept boolean"
)


def repeated_words(hashes: np.ndarray, raw: bytes) -> int:
    """Words inside 8-word windows found twice or more. hashes: of the words as they stand in raw."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    words, seen = raw.split(), {}
    for i in np.flatnonzero(hit):  # an exact check of what the hashes found
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    found = [i for at in seen.values() if len(at) > 1 for i in at]
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, np.asarray(found, dtype=np.int64) + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def bands_fail(raw: bytes, p: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole text, share of bad chunks, rejected)."""
    if not raw:
        return 0.0, 0.0, False
    ratio = len(raw) / len(packer.compress(raw))
    low, high = next((lo, hi) for size, lo, hi in reversed(p.bands) if len(raw) >= size)
    chunks = [raw[i : i + p.chunk] for i in range(0, len(raw) - p.chunk + 1, p.chunk)]
    if chunks and len(raw) % p.chunk:
        chunks.append(raw[-p.chunk :])  # the end, in a chunk as large as the others
    bad = sum(not p.chunk_low <= len(c) / len(packer.compress(c)) <= p.chunk_high for c in chunks)
    share = bad / len(chunks) if chunks else 0.0
    return ratio, share, not low <= ratio <= high or share > p.chunk_share


class Judge:
    """Measures of texts, in the order of SCHEMA."""

    def __init__(self, p: Bands) -> None:
        self.p, self.packer, self.hasher = p, zstandard.ZstdCompressor(level=p.level), WordHasher(lower=False)

    def rows(self, texts) -> Iterator[tuple]:
        raws = as_bytes(texts)
        for at, hashes, bounds in self.hasher(raws):
            for k in range(len(bounds) - 1):
                yield self.row(texts[at + k] or "" if isinstance(texts[at + k], str) else "", raws[at + k], hashes[bounds[k] : bounds[k + 1]])

    def row(self, text: str, raw: bytes, hashes: np.ndarray) -> tuple:
        n, p = len(hashes), self.p
        repeat = repeated_words(hashes, raw)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        failed = n < p.min_words or 100 * repeat > p.max_repeat_pct * n
        ratio, share, band_failed = bands_fail(raw, p, self.packer)
        return (
            n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
            failed, ratio, share, band_failed, not failed and not band_failed,
        )


def quality_rules(df: DataFrame, text: str = "text", params: Bands | None = None, prefix: str = "") -> DataFrame:
    """df with the columns of SCHEMA (their names after prefix; columns of df with those names are replaced).

    Null and empty texts have no words: base_failed. Repeated rows are judged alike, each by itself; an empty table
    gives an empty one. Any text length: one document is one task's work, at most a few times its bytes in memory.
    """
    p = params or Bands()

    @F.pandas_udf(SCHEMA)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge, names = Judge(p), [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame(list(judge.rows(batch.tolist())), columns=names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    out = df.withColumn("__judged", judged(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in {prefix + n for n in names}], *[F.col(f"__judged.{n}").alias(prefix + n) for n in names])
