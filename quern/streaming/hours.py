"""Streams: tumbling hours with late data, and the first row of each key. An extension; batch queries use the same aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def hourly_counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Count and mean per key and hour; rows later than the watermark are left out."""
    timed = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("hour"), key, "n", "mean")


def first_of_key(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key has not come before, as far back as the watermark reaches."""
    return stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """All that is there now, then ends; started again it goes on where it stopped."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 8) -> DataFrame:
    """Parquet files as they come, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def conversation_state(stream: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", ts: str | None = None, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """conversation, turns, last_turn, last_role, ended: a row for each conversation that a batch adds to, with all that has come so far.

    A turn that comes twice counts once. With ts, a conversation to which nothing has been added for `idle` before the watermark
    (`late` behind the newest time) is told once more, as ended, and forgotten: state holds open conversations alone. A turn that
    comes after that opens its conversation anew. Without ts nothing ends."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, who, at = state.get if state.exists else ([], -1, "", 0)
        seen, ended = set(seen), state.hasTimedOut
        if ended:
            state.remove()
        else:
            for frame in frames:
                seen.update(frame["turn"].tolist())
                top = frame.loc[frame["turn"].idxmax()]
                if top["turn"] > last:
                    last, who = int(top["turn"]), str(top["role"])
                if ts:
                    at = max(at, int(frame["time"].max().timestamp() * 1000))
            state.update((sorted(seen), last, who, at))
            if ts:
                state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"conversation": [k[0]], "turns": [len(seen)], "last_turn": [last], "last_role": [who], "ended": [ended]})

    told = stream.select(F.col(key).alias("conversation"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), *([F.col(ts).cast("timestamp").alias("time")] if ts else []))
    kind = dict(told.dtypes)["conversation"]
    told = told.filter("conversation IS NOT NULL AND turn IS NOT NULL")
    told = told.withWatermark("time", late) if ts else told
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return told.groupBy("conversation").applyInPandasWithState(
        update, f"conversation {kind}, turns long, last_turn long, last_role string, ended boolean", "seen array<long>, last_turn long, last_role string, at long", "update", timeout
    )
