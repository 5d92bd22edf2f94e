"""Windows, sessions and state over event streams.

Each operator takes a batch or a streaming table: under the available-now trigger both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark; times without a zone are read in that of the session."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def by_window(events: DataFrame, size: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ("event_type",), time: str = "ts", late: str = LATE) -> DataFrame:
    """Counts and sums of tumbling windows, or sliding ones where slide is given."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    sums = _marked(events, time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions of each key: runs of events with no pause of gap or more."""
    s = F.session_window(time, gap)
    found = _marked(events, time, late).groupBy(s.alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, keys: tuple[str, ...] = ("event_id",), time: str = "ts", late: str = LATE) -> DataFrame:
    """Each event once, however often it is sent, as far as the watermark remembers."""
    return _marked(events, time, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def last_seen(events: DataFrame, kind: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(event_id, key, last_ts): the latest event of a kind that each key had at each event, kept as state between batches.

    The streaming form of carrying a value forward. Events of one batch are put in order by time; those of a later batch come after.
    """

    def carry(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([time, "event_id"])
        seen = state.get[0] if state.exists else None
        out = []
        for event, ts, what in zip(rows["event_id"], rows[time], rows["event_type"]):
            if what == kind:
                seen = int(ts.value // 1000)
            out.append((event, own[0], seen))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["event_id", key, "last_us"])

    found = events.groupBy(key).applyInPandasWithState(carry, f"event_id bigint, {key} bigint, last_us bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)
    return found.select("event_id", key, F.timestamp_micros("last_us").alias("last_ts"))


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives now, as a table in memory: for tests and small results."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
