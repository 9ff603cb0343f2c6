"""Sources and sinks under names of their own: spark.read.format("quern_retrieval"), df.write.format("quern_metrics") and writeStream.

Register them once a session with `register(spark)`. Paths are those of the file systems that Arrow knows (file, hdfs, s3, gs), which
driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.sources.service import HIT, answered


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def flat_row(row: Row | dict, at: str = "") -> dict:
    """Values of nested rows under names joined by /."""
    out = {}
    for k, v in (row.asDict() if isinstance(row, Row) else row).items():
        name = f"{at}/{k}" if at else k
        out |= flat_row(v, name) if isinstance(v, Row | dict) else {name: v}
    return out


@dataclass
class Staged(WriterCommitMessage):
    """A file that is written but not part of the table yet; null for a task without rows."""

    name: str | None


class _Metrics:
    def __init__(self, path: str) -> None:
        self.path = path

    def stage(self, rows: Iterator[Row]) -> Staged:
        """All rows of a task as JSON lines in a file of its own, which a lost or repeated task leaves behind as rubbish at worst."""
        files, root = place(self.path)
        lines = [json.dumps(flat_row(r), default=str) for r in rows]
        if not lines:
            return Staged(None)
        name = f"{uuid.uuid4().hex}.json"
        files.create_dir(f"{root}/_staged", recursive=True)
        with files.open_output_stream(f"{root}/_staged/{name}") as f:
            f.write(("\n".join(lines) + "\n").encode())
        return Staged(name)

    def publish(self, messages: list[Staged | None], prefix: str) -> None:
        files, root = place(self.path)
        files.create_dir(root, recursive=True)
        for n, m in enumerate(m for m in messages if m and m.name):
            files.move(f"{root}/_staged/{m.name}", f"{root}/{prefix}-{n:05d}.json")

    def drop(self, messages: list[Staged | None]) -> None:
        files, root = place(self.path)
        for m in messages:
            if m and m.name and files.get_file_info(f"{root}/_staged/{m.name}").is_file:
                files.delete_file(f"{root}/_staged/{m.name}")


class MetricsWriter(DataSourceWriter, _Metrics):
    """Files appear when all tasks are done, or none does."""

    def __init__(self, path: str, overwrite: bool) -> None:
        super().__init__(path)
        self.overwrite = overwrite

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        if self.overwrite:
            files, root = place(self.path)
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.is_file:
                    files.delete_file(old.path)
        self.publish(messages, uuid.uuid4().hex)

    def abort(self, messages: list[Staged | None]) -> None:
        self.drop(messages)


class MetricsStreamWriter(DataSourceStreamWriter, _Metrics):
    """A batch is published once: told again after a restart, its files are dropped."""

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files, root = place(self.path)
        done = f"{root}/_done/{batchId}"
        if files.get_file_info(done).is_file:
            self.drop(messages)
            return
        self.publish(messages, f"batch-{batchId:09d}")  # under the same names, should it be told again before the next line
        files.create_dir(f"{root}/_done", recursive=True)
        files.open_output_stream(done).close()

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class MetricsSink(DataSource):
    """Metrics as JSON lines under `path`, nested names joined by /, in batches and streams, each all or nothing."""

    @classmethod
    def name(cls) -> str:
        return "quern_metrics"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("give the path of the metrics")
        return self.options["path"]

    def writer(self, schema: StructType, overwrite: bool) -> MetricsWriter:
        return MetricsWriter(self._path(), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> MetricsStreamWriter:  # noqa: N802
        return MetricsStreamWriter(self._path())


@dataclass
class Group(InputPartition):
    """A row group of a Parquet file."""

    file: str
    number: int


class RetrievalReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Group]:
        files, root = place(self.options["path"])
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        named = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))
        return [Group(f, n) for f in named for n in range(pq.ParquetFile(f, filesystem=files).num_row_groups)] or [Group("", 0)]

    def read(self, partition: Group) -> Iterator[tuple]:
        if not partition.file:
            return
        files, _ = place(self.options["path"])
        table = pq.ParquetFile(partition.file, filesystem=files).read_row_group(partition.number, columns=["query_id", "query"])
        rows = list(zip(table["query_id"].to_pylist(), table["query"].to_pylist(), strict=True))
        size = int(self.options.get("batch", "64"))
        how = {"tries": int(self.options.get("tries", "3")), "pause": float(self.options.get("pause", "1")), "timeout": float(self.options.get("timeout", "60"))}
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            for query, *hit in answered(self.options["url"], part, int(self.options.get("topk", "10")), self.options.get("errors", "fail") == "column", **how):
                yield (None if query is None else str(query), *hit)


class RetrievalSource(DataSource):
    """What a retrieval service finds for the queries of Parquet files under `path` (query_id, query): a partition a row group,
    `batch` queries a request, `topk` documents each. errors=column gives a row with the error for queries of a request that failed
    `tries` times; else it ends the job."""

    @classmethod
    def name(cls) -> str:
        return "quern_retrieval"

    def schema(self) -> str:
        return f"query_id string, {HIT}"

    def reader(self, schema: StructType) -> RetrievalReader:
        for k in ("url", "path"):
            if k not in self.options:
                raise ValueError(f"give the {k}")
        return RetrievalReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (MetricsSink, RetrievalSource):
        spark.dataSource.register(source)
