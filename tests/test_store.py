"""Compaction of the event store and loads without repeats."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from souklens.session import new_path
from souklens.sources import storage
from souklens.streaming import event_load

SCHEMA = "id long, occurred_at timestamp"


def events(spark, ids):
    return spark.createDataFrame([(i, dt.datetime(2000, 1 + i % 4, 1 + i % 25, 12)) for i in ids], SCHEMA)


def ids(df):
    return Counter(r["id"] for r in df.select("id").collect())


def files(df):
    """Files that are read, by chunk."""
    names = {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    return Counter(f.split("event_date=")[1].split("/")[0] for f in names)


def test_rows_are_seen_once_at_every_moment(spark, monkeypatch):
    path = new_path(spark, "store")
    for load in range(4):
        storage.add_load(events(spark, range(load * 50, load * 50 + 50)), path, f"l{load}", chunk="MONTH")
    want = Counter(range(200))
    assert max(files(storage.read_events(spark, path)).values()) >= 4
    before = storage.read_events(spark, path)
    # a compaction that dies before its switch: its files are there, and nobody reads them
    with monkeypatch.context() as patch:
        patch.setattr(spark.__class__, "createDataFrame", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            storage.compact(spark, path)
    assert ids(storage.read_events(spark, path)) == want
    assert storage.compact(spark, path) == 4
    assert ids(storage.read_events(spark, path)) == want == ids(before)
    assert set(files(storage.read_events(spark, path)).values()) == {1}
    # loads go on; a replaced load that is written again stays out, a new one counts
    storage.add_load(events(spark, range(50, 100)), path, "l1", chunk="MONTH")
    storage.add_load(events(spark, range(200, 240)), path, "l4", chunk="MONTH")
    want = Counter(range(240))
    assert ids(storage.read_events(spark, path)) == want
    assert storage.vacuum(spark, path) > 0
    assert ids(storage.read_events(spark, path)) == want
    storage.add_load(events(spark, range(0, 50)), path, "l0", chunk="MONTH")
    assert storage.compact(spark, path) == 4 and storage.vacuum(spark, path) > 0
    assert ids(storage.read_events(spark, path)) == want and set(files(storage.read_events(spark, path)).values()) == {1}
    assert storage.compact(spark, path) == 0 and storage.vacuum(spark, path) == 0
    since = storage.read_since(spark, path, F.lit("2000-03-01 00:00:00").cast("timestamp"), chunk="MONTH")
    assert ids(since) == Counter(i for i in range(240) if i % 4 >= 2)
    # a store that is replaced has no log any more
    storage.write_by_time(events(spark, range(9)), path, chunk="MONTH")
    assert ids(storage.read_events(spark, path)) == Counter(range(9))


def test_files_of_a_large_chunk(spark):
    path = new_path(spark, "store")
    for load in range(3):
        storage.add_load(spark.range(load * 30_000, load * 30_000 + 30_000).withColumn("occurred_at", F.lit("2000-01-01 00:00:00").cast("timestamp")), path, f"l{load}", chunk="MONTH")
    assert storage.compact(spark, path, file_bytes=150_000) == 1
    rows = storage.read_events(spark, path)
    assert 2 <= sum(files(rows).values()) <= 6 and rows.count() == 90_000 == rows.select("id").distinct().count()


def drop(path, name, rows):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as file:
        for i, day in rows:
            file.write(json.dumps({"id": str(i), "user_id": "1", "event_type": "x", "occurred_at": day and f"2000-01-{day:02d}T00:00:00Z"}) + "\n")


def test_an_event_is_stored_once(spark, tmp_path):
    """Repeats in a file, in another file of the run, and in later runs; late events; a restart; no time."""
    drops, store, state = str(tmp_path / "drops"), new_path(spark, "unique"), new_path(spark, "state")
    load = lambda: event_load.load_unique(spark, drops, store, state, "5 days", chunk="MONTH").awaitTermination()
    stored = lambda: Counter(r["id"] for r in storage.read_events(spark, store).collect())
    drop(drops, "a", [(1, 3), (1, 3), (2, 10), (3, None)])
    drop(drops, "b", [(2, 10), (4, 8)])
    load()
    assert stored() == Counter(["1", "2", "4"])
    load()  # nothing new
    # the watermark is the 5th: 5 is late, 6 is not, 2 is a repeat
    drop(drops, "c", [(5, 5), (6, 6), (2, 10), (1, 3), (7, 20)])
    load()
    assert stored() == Counter(["1", "2", "4", "6", "7"])
    drop(drops, "d", [(7, 20), (8, 15), (9, 16)])
    load()
    assert stored() == Counter(["1", "2", "4", "6", "7", "9"])
    late = event_load.not_stored(event_load.parse_times(spark.read.schema(event_load.schemas.EVENT).json(drops)), store)
    assert {r["id"] for r in late.collect()} == {"3", "5", "8"}
    storage.compact(spark, store)
    assert stored() == Counter(["1", "2", "4", "6", "7", "9"])
