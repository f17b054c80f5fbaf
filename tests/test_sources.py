"""Catalogs, snapshots and logs on disk, and the registered queries against DuckDB."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plumbline import queries
from plumbline.operators import compare
from plumbline.sources import catalog, snapshot

SF = "/root/testdata/sf0.001"


def test_parquet_database(spark, tmp_path):
    root = f"{tmp_path}/db"
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(f"{root}/t.parquet")
    os.makedirs(f"{root}/broken.parquet")
    with open(f"{root}/constraints.json", "w") as f:
        json.dump({"t": {"primary_key": ["id"], "uniques": [{"name": "u", "columns": ["name"]}]}, "modules": [{"kind": "View", "name": "v", "body": "create view v as select 1"}]}, f)
    schema = catalog.ParquetDatabase(spark, root).schema()
    assert schema.table("T").primary_key == ("id",) and not schema.table("t").column("ID").nullable and schema.modules[0].name == "v"
    assert len(schema.warnings) == 1 and "broken" in schema.warnings[0]
    assert [r.name for r in catalog.list_databases(spark, str(tmp_path)).collect()] == ["db"]
    assert catalog.probe(spark)["version"] == spark.version
    assert catalog.ParquetDatabase(spark, f"{tmp_path}/none").describe()["problem"]


def test_snapshot_converges_and_fails_whole(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    table = snapshot.SnapshotTable(spark, f"{tmp_path}/t")
    assert table.version() is None
    table.write(spark.createDataFrame([(2, "x"), (4, "d")], "id int, name string"))
    request = compare.CompareRequest(("id",))
    changes = compare.changes(source, table.read(), request)
    snapshot.stage(changes, f"{tmp_path}/staged")
    done = table.apply(snapshot.staged(spark, f"{tmp_path}/staged"), ["id"])
    assert done["rows"] == 3 and done["applied"] == {"Insert": 2, "Update": 1, "Delete": 1}
    assert {r.classification for r in compare.classify(source, table.read(), request).collect()} == {"Same"}
    before = table.version()
    with pytest.raises(RuntimeError):
        table.write(source, expected_rows=7)
    assert table.version() == before


def test_csv_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, 'q"uo,te'), (4, "two\nlines"), (None, "NULL")], "id int, s string")
    snapshot.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    text = open(glob.glob(f"{tmp_path}/csv/part-*")[0]).read()
    assert text == '"id","s"\n"1",\n"2",""\n"3","q""uo,te"\n"4","two\nlines"\n,"NULL"\n'
    back = spark.read.csv(f"{tmp_path}/csv", header=True, multiLine=True, escape='"', schema="id int, s string", emptyValue="", nullValue=None)
    assert back.where("id = 3").first().s == 'q"uo,te' and back.where("id = 4").first().s == "two\nlines" and back.count() == 5
    log = snapshot.RunLog(spark, f"{tmp_path}/log")
    assert log.latest() == []
    for i in range(3):
        log.add({"run": i})
    assert [e["run"] for e in log.latest(2)] == [2, 1]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return connection


def _plain(frame, columns):
    return frame[columns].map(lambda v: "NULL" if v is None or v != v else str(v)).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_queries_equal_duckdb(spark, duck, name):
    ours, theirs = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert _plain(ours, columns).equals(_plain(theirs, columns))


def test_golden_counts(spark):
    assert {r.classification: r.n for r in __spark_entry__.entry(spark).collect()} == {"Delete": 30, "Insert": 150, "Same": 1157, "Update": 193}


def test_partitioning_changes_nothing(spark):
    orders = queries.read(spark, SF, "orders")
    a = queries.screen.fingerprint(orders, orders.columns).first()
    b = queries.screen.fingerprint(orders.repartition(7).orderBy(F.desc("o_custkey")), orders.columns).first()
    assert a == b


def test_catalog_of_keys_types_and_hidden_names(spark, tmp_path):
    import json

    from plumbline.sources import catalog
    from plumbline.sources.catalog import ParquetDatabase

    for name in ("t", "_hidden", "p"):
        spark.createDataFrame([(1, 2, "x")], "b int, a int, s string").write.parquet(f"{tmp_path}/{name}.parquet")
    held = {
        "t": {"primary_key": ["b", "a"], "indexes": [{"name": "ix", "columns": ["s", "a"], "included": ["b"]}], "foreign_keys": [{"name": "f", "columns": ["a"], "parent": "p", "parent_columns": ["b"], "on_delete": "CASCADE", "disabled": True}], "columns": {"S": {"default": "'q'", "collation": "UNICODE"}}},
        "modules": [{"kind": "VIEW", "name": "v", "body": "CREATE VIEW v AS SELECT * FROM [t] JOIN p ON 1 = 1 JOIN t ON 1 = 1"}],
        "types": [{"name": "mood", "kind": "enum", "shape": "good,bad"}], "sequences": [{"name": "q", "increment": 5}],
    }
    (tmp_path / "constraints.json").write_text(json.dumps(held))
    schema = ParquetDatabase(spark, str(tmp_path)).schema()
    assert [t.name for t in schema.tables] == ["p", "t"] and schema.modules[0].depends_on == ("t", "p") and schema.types[0].shape == "good,bad" and schema.sequences[0].increment == 5
    t = schema.table("t")
    assert t.indexes[0].included == ("b",) and t.foreign_keys[0].on_delete == "CASCADE" and t.foreign_keys[0].disabled and t.column("s").default == "'q'"
    keys = {(r.table_name, r.kind): r["columns"] for r in catalog.constraints_frame(spark, schema).collect()}
    assert keys == {("t", "primary key"): ["b", "a"], ("t", "index"): ["s", "a"], ("t", "foreign key"): ["a"]}
    assert {(r.table_name, r.column_name): r["keys"] for r in catalog.catalog_frame(spark, schema).collect()}[("t", "a")] == ["foreign key", "index", "primary key"]


def test_profiles_and_recent_pairs(spark, tmp_path):
    from plumbline.sources.profiles import JsonFiles, RecentPairs

    files = JsonFiles(spark, f"{tmp_path}/profiles")
    assert files.names() == [] and files.load("a") is None
    files.save("a", {"x": 1})
    files.save("a", {"x": 2})
    assert files.load("a") == {"x": 2} and files.names() == ["a"] and files.delete("a") and not files.delete("a")
    with pytest.raises(ValueError):
        files.save("../a", 1)
    recent = RecentPairs(spark, f"{tmp_path}/profiles")
    for i in [*range(12), 5]:
        recent.add(f"S{i}", "t")
    assert recent.all()[0] == ("S5", "t") and len(recent.all()) == 10
    recent.add("s11", "T")
    assert recent.all()[0] == ("s11", "T") and len(recent.all()) == 10


def test_rebuild_keeps_every_row_or_the_old_version(spark, tmp_path):
    from plumbline.sources.snapshot import SnapshotTable

    table = SnapshotTable(spark, f"{tmp_path}/t")
    table.write(spark.createDataFrame([(1, "5"), (2, None)], "id int, n string"))
    table.rebuild({"id": "bigint", "m": "int", "fresh": "string"}, {"m": "N"})
    assert [tuple(r) for r in table.read().orderBy("id").collect()] == [(1, 5, None), (2, None, None)] and table.read().schema["id"].dataType.simpleString() == "bigint"
    table.write(spark.createDataFrame([(1, "no number")], "id int, n string"))
    version = table.version()
    with pytest.raises(Exception):
        table.rebuild({"id": "int", "n": "int"})
    assert table.version() == version


def test_tables_of_the_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS held LOCATION '{tmp_path}/held'")
    try:
        spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.format("json").saveAsTable("held.things")
        spark.sql("CREATE VIEW held.some AS SELECT id FROM held.things WHERE id > 1")
        base = catalog.open_database(spark, "catalog", "held", {"things": {"primary_key": ["id"]}})
        schema = base.schema()
        assert base.names() == ["things"] and schema.table("things").primary_key == ("id",) and schema.modules[0].name == "some" and schema.modules[0].depends_on == ("things",)
        row = base.volume().first()
        assert row.row_count == 2 and row.data_bytes > 0 and base.table("things").count() == 2
        with pytest.raises(ValueError):
            catalog.open_database(spark, "other", "x")
    finally:
        spark.sql("DROP DATABASE held CASCADE")
