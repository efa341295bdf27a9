"""Sinks: staged documents, refreshed copies and the time-partitioned event store.

The event store has a folder for each time chunk and load. Loads pile up, so ``compact`` rewrites the loads of a
chunk as one, in few files, and then enters that in a log beside the store. The entry is the switch: a reader takes
the log as it finds it, leaves out loads that an entry replaces, and new loads of compactions that no entry names. So
every row is seen once before, during and after a compaction, also after one that died. Replaced files stay until
``vacuum``; their names stay in the log for good, so a stream's batch that is repeated later stays out as well.
Loads may be added while a chunk is compacted. There is one compaction of a store at a time.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, Row, SparkSession, functions as F

from souklens.session import delete, exists, size_of


def replace_staging(documents: DataFrame, path: str) -> None:
    """Replace the staged documents and stamp the load time."""
    documents.select("json_doc").withColumn("loaded_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


class MaterializedCopy:
    """A stored copy of a query, completely rewritten on demand.

    A refresh writes a new folder and then a log entry with the next number. Readers use the entry
    with the largest number, so they see the old copy until the new one is whole. Copies before the
    newest ``keep`` are deleted; a reader has that many refreshes to finish. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)

    def _log(self) -> list[Row]:
        """Entries from new to old: a few bytes for each refresh that is kept."""
        if not exists(self.spark, f"{self.path}/log"):
            return []
        return self.spark.read.schema("number long, folder string, refreshed_at timestamp").parquet(f"{self.path}/log").orderBy(F.desc("number")).collect()

    def refresh(self, query: DataFrame) -> None:
        before = self._log()
        number = before[0]["number"] + 1 if before else 1
        target = f"{self.path}/copy-{number}-{uuid.uuid4().hex}"
        query.write.mode("errorifexists").parquet(target)
        entry = self.spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(target).alias("folder"), F.current_timestamp().alias("refreshed_at"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        for old in before[self.keep - 1:]:
            delete(self.spark, old["folder"])

    def current(self) -> DataFrame:
        log = self._log()
        if not log:
            raise LookupError(f"{self.path} was never refreshed")
        return self.spark.read.parquet(log[0]["folder"])


def chunk_of(ts: Column, chunk: str) -> Column:
    """First day of the time chunk (``DAY``, ``WEEK`` or ``MONTH``) that ``ts`` lies in."""
    return F.to_date(F.date_trunc(chunk, ts))


def write_by_time(events: DataFrame, path: str, time: str = "occurred_at", chunk: str = "WEEK", mode: str = "overwrite") -> None:
    """Store rows in one folder per time chunk; choose the chunk so that it holds some gigabytes.

    ``mode`` "overwrite" replaces the whole store, "append" adds a load to it.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode {mode}")
    writer = _by_time(events, f"batch-{uuid.uuid4().hex}", time, chunk)
    writer.mode(mode).parquet(path)
    if mode == "overwrite":
        delete(events.sparkSession, _log_path(path))


def add_load(events: DataFrame, path: str, name: str, time: str = "occurred_at", chunk: str = "WEEK") -> None:
    """Add rows to the store as the load ``name``; the same load written again replaces itself."""
    _by_time(events, name, time, chunk).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _by_time(events: DataFrame, load: str, time: str, chunk: str) -> DataFrameWriter:
    """Rows are range-partitioned by time first: a task writes few chunks, and a busy chunk, even a
    busy instant, is shared by several tasks."""
    dated = events.withColumns({"event_date": chunk_of(F.col(time), chunk), "load_id": F.lit(load)})
    return dated.repartitionByRange(F.col(time), F.xxhash64(*events.columns)).write.partitionBy("event_date", "load_id")


#: Loads of compactions begin with this; other loads must not.
COMPACTED = "compacted-"
_ENTRY = "event_date string, load string, replaced array<string>"


def _log_path(path: str) -> str:
    return path.rstrip("/") + ".compactions"


def _log(spark: SparkSession, path: str) -> list[Row]:
    """Entries of the log: a row for each compacted chunk, with the names of the loads that it replaced."""
    where = _log_path(path)
    return spark.read.schema(_ENTRY).json(where).collect() if exists(spark, where) else []


def _hidden(log: list[Row]) -> Column:
    """Whether the rows of a load of a chunk are to be left out; told from folder names alone."""
    folder = F.concat_ws("/", F.col("event_date").cast("string"), "load_id")
    replaced = [f"{e['event_date']}/{name}" for e in log for name in e["replaced"]]
    current = [f"{e['event_date']}/{e['load']}" for e in log]
    # every row has a load; coalesce keeps Spark from adding a test for that to the filters of folders
    unfinished = F.coalesce("load_id", F.lit("")).startswith(COMPACTED) & ~folder.isin(current)
    return unfinished | folder.isin(replaced)


def _live(spark: SparkSession, path: str) -> tuple[DataFrame, list[Row]]:
    log = _log(spark, path)
    stored = spark.read.parquet(path)
    return stored.where(~_hidden(log)), log


def _folders(rows: DataFrame) -> dict[tuple[str, str], list[str]]:
    """(chunk, load) -> files, from the names that Spark has listed anyway."""
    found: dict[tuple[str, str], list[str]] = {}
    for file in rows.inputFiles():
        parts = dict(p.split("=", 1) for p in file.split("/") if "=" in p)
        found.setdefault((unquote(parts["event_date"]), unquote(parts["load_id"])), []).append(file)
    return found


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store, of batch and stream loads, with the first day of their chunk."""
    return _live(spark, path)[0].drop("load_id")


def read_since(spark: SparkSession, path: str, start: Column, time: str = "occurred_at", chunk: str = "WEEK") -> DataFrame:
    """Rows from ``start`` on; chunks before it are not read. ``chunk`` is that of the store."""
    rows = read_events(spark, path)
    return rows.filter((F.col("event_date") >= chunk_of(start, chunk)) & (F.col(time) >= start))


def compact(spark: SparkSession, path: str, time: str = "occurred_at", least_files: int = 2, file_bytes: int = 256 << 20) -> int:
    """Rewrite the loads of every chunk with ``least_files`` files or more as one load with files of about
    ``file_bytes``, and switch readers to it; the number of such chunks. Files are cut by range of time: a chunk gets
    at most its share of them and one more."""
    rows, log = _live(spark, path)
    gone = {(e["event_date"], name) for e in log for name in e["replaced"]}
    current = {(e["event_date"], e["load"]) for e in log}
    by_chunk: dict[str, dict[str, list[str]]] = {}
    for (chunk, load), files in _folders(spark.read.parquet(path)).items():
        if (chunk, load) not in gone and (not load.startswith(COMPACTED) or (chunk, load) in current):
            by_chunk.setdefault(chunk, {})[load] = files
    due = {chunk: loads for chunk, loads in by_chunk.items() if sum(map(len, loads.values())) >= least_files}
    if not due:
        return 0
    name = COMPACTED + uuid.uuid4().hex
    folders = {file.rsplit("/", 1)[0] for loads in due.values() for files in loads.values() for file in files}
    pieces = max(1, -(-sum(size_of(spark, folder) for folder in folders) // file_bytes))
    # the loads that were found, and no later ones
    taken = F.concat_ws("/", F.col("event_date").cast("string"), "load_id").isin([f"{chunk}/{load}" for chunk, loads in due.items() for load in loads])
    columns = [c for c in rows.columns if c not in ("event_date", "load_id")]
    (rows.where(taken).withColumn("load_id", F.lit(name)).repartitionByRange(pieces, "event_date", F.col(time), F.xxhash64(*columns))
     .write.partitionBy("event_date", "load_id").mode("append").parquet(path))
    entries = [(chunk, name, sorted(loads)) for chunk, loads in due.items()]
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(_log_path(path))
    return len(due)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files that compactions replaced and those of compactions that died; the number of folders. No reader
    that began before the last compaction, and no compaction, may be running."""
    log = _log(spark, path)
    gone = {(e["event_date"], name) for e in log for name in e["replaced"]}
    current = {(e["event_date"], e["load"]) for e in log}
    dead = [f for f in _folders(spark.read.parquet(path)) if f in gone or f[1].startswith(COMPACTED) and f not in current]
    for chunk, load in dead:
        delete(spark, f"{path}/event_date={chunk}/load_id={load}")
    return len(dead)
