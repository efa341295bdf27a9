from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from souklens import session
from souklens.plans import access, dimensions
from souklens.sources import delimited, documents, relational, schemas, storage
from souklens.sources.market import Market
from souklens.streaming import event_load
from souklens.workload import ORACLES, QUERIES
from tests.compare import difference


def write(path, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.txt").write_text(text)
    return str(path)


def test_external_csv_rows(spark, tmp_path):
    path = write(tmp_path / "c", 'a,b,c\n1,x,y\n2,"q, ""r""",\n3,short\n4,too,long,line\n,,\n')
    rows = delimited.read_external(spark, path, "a string, b string, c string").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(None, None, None), ("1", "x", "y"), ("2", 'q, "r"', None), ("3", "short", None), ("4", "too", "long")]


def test_copy_csv_tells_empty_from_null(spark, tmp_path):
    path = write(tmp_path / "c", 'a,b,n\n1,,5\n2,"",\n3,x,7\n')
    rows = delimited.read_copy(spark, path, "a string, b string, n int").orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", None, 5), ("2", "", None), ("3", "x", 7)]


def test_copy_csv_keeps_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b",\n\nc', "x"), (2, "", None), (3, None, "\n")], "n int, a string, b string")
    delimited.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, delimited.read_copy(spark, str(tmp_path / "c"), "n int, a string, b string").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|Malformed"):
        delimited.read_copy(spark, str(tmp_path / "c"), "n int, a string, b string", line_breaks=False).collect()


@pytest.mark.parametrize("line_breaks", [True, False])
def test_copy_csv_stops_at_or_returns_what_it_cannot_read(spark, tmp_path, line_breaks):
    path, layout = write(tmp_path / "c", 'a,n\n1,5\n2,oops\n3\n4,,6\n"",\n'), "a string, n int"
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|Malformed"):
        delimited.read_copy(spark, path, layout, line_breaks).collect()
    rows, rejects = delimited.read_copy_rejects(spark, path, layout, line_breaks)
    assert sorted(map(tuple, rows.collect())) == [("", None), ("1", 5)] and rows.columns == ["a", "n"]
    assert sorted(r.record for r in rejects.collect()) == ["2,oops", "3", "4,,6"]
    assert rejects.count() == 3 and rows.count() == 2


@pytest.mark.parametrize("layout", [schemas.MARKETPLACE_INVOICE_CSV, schemas.MARKETPLACE_INVOICE_LINE_CSV, schemas.ORDER_CSV,
                                    schemas.ORDER_ITEM_CSV, schemas.EVENT_CSV])
def test_copy_round_trip_of_every_layout(spark, tmp_path, layout):
    source = spark.createDataFrame([], layout)
    kinds = {"string": F.lit('a, "b"'), "timestamp": F.lit("2024-01-02 03:04:05.123456").cast("timestamp"), "short": F.lit(3).cast("smallint")}
    values = [kinds.get(f.dataType.typeName(), F.lit("12.34").cast(f.dataType)).alias(f.name) for f in source.schema]
    full = spark.range(1).select(*values)
    rows = full.unionByName(full.select(*[F.col(full.columns[0]), *[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields[1:]]]))
    delimited.write_csv(rows, str(tmp_path / "c"))
    read = delimited.read_copy(spark, str(tmp_path / "c"), layout)
    assert sorted(map(str, read.collect())) == sorted(map(str, rows.collect()))


def test_array_documents_with_wrong_types(spark):
    doc = json.dumps([{"id": "a", "quantity": 3, "unit_price_usd": 1.5}, {"id": "b", "quantity": "many", "unit_price_usd": 2.25}, {"id": "c"}])
    staged = spark.createDataFrame([(doc,)], "json_doc string")
    rows = access.order_items(staged).select("id", "quantity", F.col("unit_price_usd").cast("double")).collect()
    assert [tuple(r) for r in rows] == [("a", 3, 1.5), ("b", None, 2.25), ("c", None, None)]


def test_event_metadata_stays_json(spark):
    staged = spark.createDataFrame([(json.dumps([{"id": "e", "metadata": {"a": {"b": [1, 2]}}}]),)], "json_doc string")
    assert json.loads(access.events(staged).first()["metadata"]) == {"a": {"b": [1, 2]}}


def test_catalogue_ids_and_times_in_both_forms(spark):
    docs = [{"id": {"$binary": {"base64": "AAAAAAAAAAAAAAAAAAAAAQ==", "subType": "04"}}, "created_at": {"$date": 1704067200250}, "is_active": True, "price_usd": 9.5},
            {"id": "0000-plain", "created_at": "2024-01-01T00:00:00Z", "is_active": "False", "price_usd": "many"},
            {"id": {"$binary": {"base64": "@@"}}, "created_at": "never"}]
    rows = access.products(spark.createDataFrame([(json.dumps(docs),)], "json_doc string"))
    found = [tuple(r) for r in rows.select("product_id_b64", "product_id", "created_at", "is_active", F.col("price_usd").cast("double")).collect()]
    assert found == [
        ("AAAAAAAAAAAAAAAAAAAAAQ==", "00000000-0000-0000-0000-000000000001", dt.datetime(2024, 1, 1, 0, 0, 0, 250000), "true", 9.5),
        (None, "0000-plain", dt.datetime(2024, 1, 1), "False", None), ("@@", None, None, None, None)]


def test_result_sets(spark):
    doc = json.dumps({"data": {"fields": ["x"], "values": [["a", "A", "b", "B", 3], ["a", None, "c"], ["a", "A", "d", "D", "no number"]]}})
    rows = documents.rows_of_result_set(spark.createDataFrame([(doc,)], "json_doc string"), documents.PAIR_POSITIONS).collect()
    assert [tuple(r) for r in rows] == [("a", "A", "b", "B", 3), ("a", None, "c", None, None), ("a", "A", "d", "D", None)]


def test_documents_are_typed_only_where_they_are_text(spark):
    text = spark.createDataFrame([("9.5", "True", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.25Z")],
                                 "price_usd string, is_active string, created_at string, updated_at string")
    typed = documents.type_scalars(text)
    assert tuple(typed.first()) == (9.5, True, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 250000))
    assert documents.type_scalars(typed).collect() == typed.collect()


def test_unparseable_attributes_stay_text(spark):
    rows = documents.parse_attributes(spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,)], "attributes string"))
    assert [(r.a, r.attributes_text) for r in rows.select(F.col("attributes").isNotNull().alias("a"), "attributes_text").collect()] == [
        (True, None), (False, "{oops"), (False, None)]


def test_materialized_copy_shows_the_last_refresh(spark, tmp_path):
    copy = storage.MaterializedCopy(spark, str(tmp_path / "m"))
    copy.refresh(spark.range(3))
    before = copy.current()
    copy.refresh(spark.range(5))
    assert copy.current().count() == 5 and before.count() == 3
    copy.refresh(spark.range(7))
    assert copy.current().count() == 7 and len(list((tmp_path / "m").glob("copy-*"))) == 2
    assert storage.MaterializedCopy(spark, str(tmp_path / "m")).current().count() == 7
    with pytest.raises(LookupError):
        storage.MaterializedCopy(spark, str(tmp_path / "none")).current()


def test_time_store_reads_only_later_chunks(spark, tmp_path):
    events = spark.range(100).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("occurred_at"))
    start = F.lit("2024-02-15 12:00:00").cast("timestamp")
    for chunk in ("DAY", "WEEK", "MONTH"):
        path = str(tmp_path / chunk)
        storage.write_by_time(events, path, chunk=chunk)
        late = storage.read_since(spark, path, start, chunk=chunk)
        assert late.count() == events.filter(F.col("occurred_at") >= start).count()
        plan = late._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan


def test_drop_reads_wanted_columns_only(spark):
    rows = relational.read_drop(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey", "o_orderdate"], ("o_orderdate", "o_orderkey", 10))
    assert rows.count() == 10
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in rows._jdf.queryExecution().toString()


def test_jdbc_reads_are_parallel():
    options = relational.jdbc_options("jdbc:x", "orders", "id", "0", "100", 16)
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "id"


def test_stream_loads_each_file_once_and_late_events(spark, tmp_path):
    drops, store, state = (str(tmp_path / n) for n in ("drops", "store", "state"))

    def drop(ids):
        rows = [(str(i), "u", "search", None, "{}", f"2024-01-{i:02d}T00:00:00+00:00") for i in ids]
        spark.createDataFrame(rows, schemas.EVENT).write.mode("append").json(drops)
        event_load.load(spark, drops, store, state).awaitTermination()

    drop([12, 20, 21, 28])
    drop([3, 4])
    event_load.load(spark, drops, store, state).awaitTermination()
    assert sorted(int(r.id) for r in storage.read_events(spark, store).collect()) == [3, 4, 12, 20, 21, 28]


def test_batch_and_stream_loads_share_a_store(spark, tmp_path):
    drops, store, state = (str(tmp_path / n) for n in ("drops", "store", "state"))
    start = F.lit("2023-01-01").cast("timestamp")

    def rows(ids):
        return spark.createDataFrame([(str(i), "u", "search", None, "{}", f"2024-01-{i:02d}T00:00:00+00:00") for i in ids], schemas.EVENT)

    def batch(ids, mode):
        storage.write_by_time(rows(ids).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")), store, mode=mode)

    def stream(ids):
        rows(ids).write.mode("append").json(drops)
        event_load.load(spark, drops, store, state).awaitTermination()

    def found():
        return sorted(int(r.id) for r in storage.read_since(spark, store, start).collect())

    batch(range(1, 11), "overwrite")
    stream([11, 12, 13])
    assert found() == [*range(1, 14)]
    batch([14], "append")
    stream([15, 2])
    assert found() == sorted([*range(1, 16), 2])
    # the last batch failed after its rows were written: its commit is missing, so it runs again
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    event_load.load(spark, drops, store, state).awaitTermination()
    assert found() == sorted([*range(1, 16), 2])
    with pytest.raises(ValueError):
        batch([1], "ignore")


def test_partitions_follow_the_input_size():
    def start(size):
        return int(session.sized_for(size)["spark.sql.adaptive.coalescePartitions.initialPartitionNum"])
    assert start(1e9) == 200
    assert 30_000 < start(100e12) < 50_000
    assert start(1e16) == 100_000


def test_shared_folder_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == (configured.rstrip("/") if configured else session.shared_folder(spark))
    assert session.new_path(spark, "t").startswith(session.shared_folder(spark) + "/souklens/")


class _Cluster:
    """A session of a cluster with a folder setting, as far as ``shared_folder`` looks."""

    def __init__(self, spark, folder):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, self
        self.master, self.applicationId = "spark://host:7077", "a"
        self._jvm, self._jsc = spark.sparkContext._jvm, spark.sparkContext._jsc


def test_a_cluster_needs_a_shared_folder(spark):
    assert session.shared_folder(_Cluster(spark, "hdfs://name/tmp/")) == "hdfs://name/tmp"
    assert session.shared_folder(_Cluster(spark, "file:///mnt/all")) == "file:///mnt/all"
    for folder in (None, "/tmp/run"):
        with pytest.raises(RuntimeError):
            session.shared_folder(_Cluster(spark, folder))


class _Mounted(_Cluster):
    """The same session where jobs run; ``lost`` rows are written on machines that do not share the folder."""

    def __init__(self, spark, folder, app, lost=0):
        super().__init__(spark, folder)
        self.applicationId, self.lost, self.trials, self.spark = app, lost, 0, spark
        self.defaultParallelism, self.read = spark.sparkContext.defaultParallelism, spark.read

    def range(self, start, end, step, tasks):
        self.trials += 1
        return self.spark.range(start, end - self.lost, step, tasks)


def test_a_folder_without_a_scheme_is_shared_if_a_trial_shows_it(spark, tmp_path):
    mounted = _Mounted(spark, f"{tmp_path}/all/", "mounted")
    for _ in range(2):
        assert session.shared_folder(mounted) == f"{tmp_path}/all"
    assert mounted.trials == 1 and not list(tmp_path.glob("all/souklens/mounted/*"))
    for lost in (1, 2 * spark.sparkContext.defaultParallelism):
        with pytest.raises(RuntimeError, match="rows written"):
            session.shared_folder(_Mounted(spark, f"{tmp_path}/own", "apart", lost))


@pytest.mark.parametrize("name", ["active_products", "agg_median", "bought_with", "cons_sub_billing", "cons_user_subscription", "graph_pairs_maintained"])
def test_queries_run_in_a_cluster_whose_folder_has_no_scheme(spark, tmp_path, monkeypatch, con, name):
    settings = type(spark.conf)
    known = settings.get
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(settings, "get", lambda self, key, *rest: str(tmp_path) if key == "spark.checkpoint.dir" else known(self, key, *rest))
    (tmp_path / "data").symlink_to("/root/testdata/sf0.001")  # a path of its own: tables are kept by path
    assert difference(QUERIES[name](spark, str(tmp_path / "data")), con, ORACLES[name]) is None
    assert list(tmp_path.glob("souklens/*/*"))


def test_scope_deletes_what_was_written_in_it(spark):
    kept = session.written(spark.range(3), "kept")
    with session.scope(spark):
        inner = session.written(spark.range(4), "inner")
        with session.outside_scopes():
            outer = session.written(spark.range(5), "outer")
        assert inner.count() == 4
        path = inner.inputFiles()[0]
    assert not session.exists(spark, path) and kept.count() == 3 and outer.count() == 5


def test_queries_run_after_written_tables_are_dropped(spark):
    market = Market(spark, "/root/testdata/sf0.001")
    assert market.products().count() > 0
    session.drop_written(spark)
    assert dimensions.product(market.products()).count() > 0 and market.tier_pricing().count() > 0
