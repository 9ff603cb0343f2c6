"""What the operators of this subpackage share: written intermediates, tables, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only if driver and
    executors are one process; a cluster without a shared folder is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quern_dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = spark._quern_dir = "file://" + tempfile.mkdtemp(prefix="quern-")
    return d


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here, and what it holds no longer changes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing needs any more. Shuffle files of finished steps go when the driver's heap is
    collected (spark.cleaner.periodicGC.interval, half an hour by default): a job of many steps asks for that here."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """An id for each row, repeated rows included. Only fixed once the result is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that few of their values become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def weighed(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts have about `size` bytes, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def raw_texts(column: pa.Array) -> list[bytes]:
    """Strings of an Arrow column as UTF-8; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


class WordHasher:
    """64-bit hashes of the words of texts, many texts at once; lower: A-Z count as a-z; sizes: with the words' bytes."""

    SLICE = 1 << 18  # bytes of text hashed at once: small enough for a core's cache

    def __init__(self, lower: bool = True, sizes: bool = False) -> None:
        self.sizes = sizes
        self._code = np.arange(1, 257, dtype=np.uint64)
        if lower:
            self._code[65:91] += np.uint64(32)
        self._up = _powers(_P, 1 << 16)
        self._down = _powers(_P_INV, 1 << 16)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            self._up, self._down = _powers(_P, n), _powers(_P_INV, n)

    def __call__(self, texts):
        """texts: bytes objects. Yields (index of the first, word hashes, words before each text: len + 1) by slices."""
        at = 0
        while at < len(texts):
            n, size = at, 0
            while n < len(texts) and (n == at or size + len(texts[n]) < self.SLICE):
                size += len(texts[n]) + 1
                n += 1
            yield at, *self._slice(texts[at:n])
            at = n

    def _slice(self, texts):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        self._grow(len(raw))
        sep = _SEP[raw]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        firsts = np.concatenate([[0], np.cumsum(lens + 1)]) + 1
        bounds = np.searchsorted(starts, firsts)
        if not len(starts):
            none = np.zeros(0, dtype=np.uint64)
            return (none, none.astype(np.int64)) if self.sizes else none, bounds
        value = self._code[raw] * self._up[: len(raw)]
        value[sep] = 0
        h = np.add.reduceat(value, starts) * self._down[starts]
        h = mix64(h ^ mix64((ends - starts).astype(np.uint64)))
        return (h, ends - starts) if self.sizes else h, bounds


def as_bytes(column) -> list[bytes]:
    """Texts of a pandas column as UTF-8; null is empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in column]
