"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution splits skewed join partitions (also when that costs one more shuffle),
#: merges small shuffle partitions and turns a join into a broadcast join once the measured
#: size of a side is below the threshold. Streams keep their state on disk, not in the heap.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def sized_for(input_bytes: float, per_task: int = 256 << 20) -> dict[str, str]:
    """Partition settings for an input size: scan and shuffle partitions that fit in a task's memory.

    The reports reduce their input before they shuffle it, so a tenth of the input is taken as the
    largest shuffle. It starts with that many partitions; adaptive execution merges what is smaller.
    """
    start = min(max(200, int(input_bytes / 10 / per_task)), 100_000)
    return {"spark.sql.files.maxPartitionBytes": str(per_task), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(per_task),
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(start)}


def build_session(
    app: str = "souklens", master: str | None = None, input_bytes: float | None = None, **options: str,
) -> SparkSession:
    """A session with the settings above, sized for the input if that is given; ``options`` override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sizes = sized_for(input_bytes) if input_bytes else {}
    for key, value in {**SETTINGS, **sizes, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def check_settings(spark: SparkSession) -> None:
    """Times are UTC: a session made elsewhere with another time zone is set to it, with a warning, since
    results would differ. Settings of speed are the caller's own and stay."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        warnings.warn(f"spark.sql.session.timeZone is {zone}; it is set to UTC", stacklevel=3)
        spark.conf.set("spark.sql.session.timeZone", "UTC")


#: Folders made for local sessions without a setting, by application.
_local: dict[str, str] = {}

#: Folders that a trial has shown to be shared, by application.
_tried: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir`` or else by ``setCheckpointDir``.

    A local session without either gets one new folder; a cluster session without either is refused.
    Where the setting has no scheme and the default file system is the machine's own, the folder may be
    a mount that all machines share or a folder of each of them. A trial tells, once for an application;
    a folder that does not pass is refused. A ``file:`` setting says that it is a shared mount; a folder
    of ``setCheckpointDir`` always has a scheme, which Spark adds, so on the machines' own file system it is tried.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.split("[")[0] == "local"
    if configured:
        folder = configured.rstrip("/")
        if not local and ":" not in configured.split("/")[0] and _default_scheme(spark) == "file":
            _try_shared(spark, folder)
        return folder
    given = spark.sparkContext._jsc.getCheckpointDir()
    if given.isPresent():
        folder = given.get()
        if not local and folder.startswith("file:"):
            _try_shared(spark, folder)
        return folder
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local[app]


def _try_shared(spark: SparkSession, folder: str) -> None:
    """Refuse ``folder`` unless rows that tasks on all cores write there are all found and read again."""
    app = spark.sparkContext.applicationId
    if (app, folder) in _tried:
        return
    path = f"{folder}/souklens/{app}/trial-{uuid.uuid4().hex[:12]}"
    try:
        tasks = 2 * spark.sparkContext.defaultParallelism
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).agg({"id": "count"}).first()[0]
        delete(spark, path)
    except Exception as error:
        raise RuntimeError(f"a trial of the checkpoint folder failed; name a folder shared by all executors: {folder}") from error
    if found != tasks:
        raise RuntimeError(f"the checkpoint folder is one of each machine: {found} of {tasks} rows written to {folder} are found again")
    _tried.add((app, folder))


def _default_scheme(spark: SparkSession) -> str:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/souklens/{app}/{name}-{uuid.uuid4().hex[:12]}"


#: Paths written by ``written`` inside the scopes that are open now, innermost last.
_scopes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so the rows are computed once however many branches read them, and
    it gives Catalyst the exact size of the table, on which it decides whether to broadcast. The
    table stays until the scope (see ``scope``) that it was written in ends, or ``drop_written``.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path."""
    path = new_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    free_with_scope(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def free_with_scope(path: str) -> None:
    """Delete ``path`` when the innermost open scope ends; without one it stays."""
    if _scopes:
        _scopes[-1].append(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; frames that read them must be done by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            delete(spark, path)


@contextmanager
def outside_scopes() -> Iterator[None]:
    """For tables that are kept for the session, whoever asks for them first."""
    held, _scopes[:] = list(_scopes), []
    try:
        yield
    finally:
        _scopes[:] = held


#: Called with the application's id when its written tables are deleted.
forget: list[Callable[[str], None]] = []


def drop_written(spark: SparkSession) -> None:
    """Delete the tables this application wrote to the shared folder, and forget those kept for reuse."""
    app = spark.sparkContext.applicationId
    delete(spark, f"{shared_folder(spark)}/souklens/{app}")
    for call in forget:
        call(app)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where)


def is_whole(spark: SparkSession, path: str, size: int) -> bool:
    """Whether the files below ``path`` still have ``size`` bytes together; cleaners may leave folders whose files are gone."""
    return exists(spark, path) and size_of(spark, path) == size


def delete(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    where, system = _path(spark, path)
    return system.getContentSummary(where).getLength()


def is_broadcastable(df: DataFrame) -> bool:
    """Whether Catalyst, by its size of ``df``, broadcasts it in a join of its own accord."""
    session = df.sparkSession._jsparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) <= session.sessionState().conf().autoBroadcastJoinThreshold()
