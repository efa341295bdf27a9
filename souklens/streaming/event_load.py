"""Continuous load of event files into the time-partitioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from souklens.functions.times import parse_iso
from souklens.sources import schemas
from souklens.sources.storage import add_load, read_events


def event_stream(spark: SparkSession, drops: str) -> DataFrame:
    """Event documents, one per line, with a typed time."""
    return parse_times(spark.readStream.schema(schemas.EVENT).json(drops))


def parse_times(events: DataFrame) -> DataFrame:
    return events.withColumn("occurred_at", parse_iso(F.col("occurred_at")))


def load(spark: SparkSession, drops: str, store: str, checkpoint: str, chunk: str = "WEEK") -> StreamingQuery:
    """Append what has arrived since the last run to a store of ``write_by_time``, then stop.

    Every micro-batch is written like a batch load, under a name made from the id that the checkpoint
    holds and the batch's number. A batch that is repeated after a failure replaces what its first run
    left, so each file counts once. The store keeps no log of the stream: batch and stream loads may
    take turns, and readers see both. No state is kept and no event is too late.
    """
    return _into(event_stream(spark, drops), store, checkpoint, chunk)


def load_unique(spark: SparkSession, drops: str, store: str, checkpoint: str, delay: str, chunk: str = "WEEK", key: str = "id") -> StreamingQuery:
    """Like ``load``, but of several events with one ``key`` only the first to arrive is stored.

    Keys are remembered in the stream's state store until the watermark, which runs ``delay`` behind the newest time
    seen, is ``delay`` past them; the state thus has the keys of some ``delay`` of events, dealt by key over the shuffle
    partitions. Repeats that arrive while their key is remembered are left out, in the same run or a later one. An event
    whose time is not after the watermark of the runs and batches before is late: it is not stored, since nobody
    knows any more whether it was; ``not_stored`` finds it. Of two events with one key in one batch either may be the
    first. Events without a time are left out, like late ones.
    """
    events = event_stream(spark, drops).where(F.col("occurred_at").isNotNull())
    return _into(events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark([key]), store, checkpoint, chunk)


def not_stored(events: DataFrame, store: str, key: str = "id") -> DataFrame:
    """Rows of ``events`` whose key the store does not have, for a batch load of late events."""
    return events.join(read_events(events.sparkSession, store).select(key), key, "left_anti")


def _into(events: DataFrame, store: str, checkpoint: str, chunk: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        add_load(batch, store, f"{stream}-{number}", chunk=chunk)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
