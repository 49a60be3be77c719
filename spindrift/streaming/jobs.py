"""Streams: debounced changes, upserts, roll-ups, session state and history.

Each function takes a streaming or a batch DataFrame, so a stream's result can
be compared with its batch twin.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import shared_folder
from ..sources import tables
from ..sources.files import upsert


def debounced(changes: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds", by: str = "path", ts: str = "ts") -> DataFrame:
    """Bursts of changes: one row per key and session without a gap of ``quiet``,
    with the burst's last operation. A deletion thus cancels earlier changes."""
    rows = changes.withWatermark(ts, late) if changes.isStreaming else changes
    g = rows.groupBy(F.session_window(ts, quiet).alias("w"), by).agg(F.max_by("op", ts).alias("op"), F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "n")


def latest_changes(changes: DataFrame, by: str = "path", ts: str = "ts") -> DataFrame:
    """The last operation per key; a move is a deletion and a change."""
    return changes.groupBy(by).agg(F.max_by("op", ts).alias("op"))


def rolled_up(points: DataFrame, width: str = "1 day", late: str = "1 day", name: str = "name", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, sum, least and greatest value by name and window."""
    rows = points.withWatermark(ts, late) if points.isStreaming else points
    g = rows.groupBy(F.window(ts, width).alias("w"), name).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return g.select(name, F.col("w.start").alias("start"), "n", "total", "least", "greatest")


def work_units(events: DataFrame, gap_seconds: int = 1800, by: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Stretches of events without a longer gap: ``unit`` numbers, start, end, n."""
    w = W.partitionBy(by).orderBy(ts, tie)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    marked = events.withColumn("_new", F.coalesce((seconds > gap_seconds).cast("int"), F.lit(1))).withColumn("unit", F.sum("_new").over(w))
    return marked.groupBy(by, "unit").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def sessions(turns: DataFrame, by: str = "session_id", order: str = "turn") -> DataFrame:
    """State of each session: queries in order, items once each in order of
    first use, the last focus."""
    g = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "query", "chunks", "focus"))).alias("all"))
    return g.select(
        by,
        F.transform("all", lambda x: x["query"]).alias("queries"),
        F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["chunks"], F.array().cast("array<string>"))))).alias("chunks"),
        F.element_at(F.transform("all", lambda x: x["focus"]), -1).alias("focus"),
    )


def upserting(changes: DataFrame, path: str, key: list[str], order: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Keeps a table folder up to date with a stream of rows (``op``: upsert or
    delete). Each batch commits the table's next version, marked with the
    stream's and the batch's number, so a repeated batch changes nothing; a
    table that cannot be read stops the stream."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        now = tables.current(spark, path, schema)
        columns = now.columns
        last = batch.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        merged = upsert(now, last.where("op <> 'delete'").select(*columns), key).join(last.where("op = 'delete'").select(*key), key, "left_anti")
        tables.commit(merged.select(*columns), path, mark=f"{stream}-{epoch}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appending(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet folder in micro-batches (buffered metrics,
    event logs); the sink's own log makes each batch count once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end: its last complete result, or in another
    ``mode`` all rows it gave, as a table in the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        tables.commit(batch, f"{folder}/out", mark=str(epoch), keep=1 if mode == "complete" else 1 << 30)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if mode == "complete":
        return tables.current(spark, f"{folder}/out", stream.schema)
    parts = [f"{folder}/out/{v}" for _, v in tables.versions(spark, f"{folder}/out")]
    return spark.read.schema(stream.schema).parquet(*parts) if parts else spark.createDataFrame([], stream.schema)


class Watch:
    """A stream that is started and stopped by name; starting twice is an error."""

    def __init__(self, make: Callable[[], StreamingQuery]):
        self._make, self._query = make, None

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def start(self) -> StreamingQuery:
        if self.running:
            raise RuntimeError("the watch is running already")
        self._query = self._make()
        return self._query

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None


def history(rows: DataFrame, most: int, by: str | None, order: str) -> DataFrame:
    """The last ``most`` rows (of each group)."""
    if by is None:
        return rows.orderBy(F.desc(order)).limit(most)
    w = W.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def live(pins: DataFrame, now) -> DataFrame:
    """Pins that have not expired."""
    return pins.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


Handler = Callable[[DataFrame], DataFrame]
