"""Plans applied as a whole: columns, keys and rows of several tables at once."""

import json

import pytest

from plumbline.plans import rebuild, schema_diff
from plumbline.plans.selection import DATABASE, Selection
from plumbline.session import CompareSession, TableChoice
from plumbline.sources.catalog import ParquetDatabase
from plumbline.sources.manifest import VersionedDatabase

FK = {"name": "to_b", "columns": ["b"], "parent": "b", "parent_columns": ["id"]}
SOURCE = {"a": {"primary_key": ["id"], "foreign_keys": [FK], "columns": {"id": {"identity": "(1,1)"}, "twice": {"computed": "n * 2"}, "four": {"computed": "[twice] * 2"}}}, "b": {"primary_key": ["id"]}, "fresh": {"primary_key": ["id"]}}
TARGET = {"a": {"primary_key": ["id"], "foreign_keys": [FK]}, "b": {"primary_key": ["id"]}}


@pytest.fixture
def session(spark, tmp_path):
    root = f"{tmp_path}/source"
    spark.createDataFrame([(1, 10, 5, 10, 20, "x"), (3, 11, 6, 12, 24, "y")], "id bigint, b int, n int, twice int, four int, note string").write.parquet(f"{root}/a.parquet")
    spark.createDataFrame([(10, "p"), (11, "q")], "id int, s string").write.parquet(f"{root}/b.parquet")
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{root}/fresh.parquet")
    (tmp_path / "source" / "constraints.json").write_text(json.dumps(SOURCE))
    target = VersionedDatabase(spark, f"{tmp_path}/target", TARGET)
    with target.transaction() as t:
        t.write("a", spark.createDataFrame([(1, 10, "5", 99), (2, 10, None, 99)], "id int, b int, n string, old int"))
        t.write("b", spark.createDataFrame([(10, "p")], "id int, s string"))
        t.write("gone", spark.createDataFrame([(1,)], "id int"))
    return CompareSession(ParquetDatabase(spark, root), target)


def test_columns_keys_and_rows_change_at_once(spark, session):
    session.selections.append(Selection(DATABASE))
    session.select("b", TableChoice())
    made = session.script()
    assert set(made.rebuilds) == {"a"} and any("identity" in w for w in made.rebuilds["a"].why)
    told = session.apply(session.target, "Dev", "target")
    assert told["outcome"] == "Blocked" and {"drops gone", "drops a.old"} <= {w for why in told["why"] for w in ("drops gone", "drops a.old") if w in why}
    done = session.apply(session.target, "Dev", "target", acknowledged=True)
    assert done["outcome"] == "Applied" and session.target.names() == ["a", "b", "fresh"]
    rows = [tuple(r) for r in session.target.table("a").orderBy("id").collect()]
    assert rows == [(1, 10, 5, 10, 20, None), (2, 10, None, None, None, None)]
    assert [r.id for r in session.target.table("b").orderBy("id").collect()] == [10, 11]
    diffs = schema_diff.schema_diff(session.source.schema(), session.target.schema())
    assert [d for d in diffs if d.changed] == []
    assert session.target.current().number == 2


def test_a_value_that_does_not_fit_leaves_everything_as_it_was(spark, session):
    with session.target.transaction() as t:
        t.write("a", spark.createDataFrame([(1, 10, "five", 99)], "id int, b int, n string, old int"))
    before = session.target.current()
    session.selections.append(Selection(DATABASE))
    session.select("b", TableChoice())
    session.script()
    with pytest.raises(Exception, match="doesn't fit"):
        session.apply(session.target, "Dev", "target", acknowledged=True)
    assert session.target.current() == before and session.target.names() == ["a", "b", "gone"]


def test_a_plan_reviewed_on_an_older_state_is_refused(spark, session):
    session.select("b", TableChoice())
    session.script()
    with session.target.transaction() as t:
        t.write("b", t.read("b"))
    told = session.apply(session.target, "Dev", "target")
    assert told["outcome"] == "Blocked" and "b changed since state 1" in told["why"][0]


def test_the_statements_of_a_rebuild_run_on_a_catalog(spark, session, tmp_path):
    spark.sql(f"CREATE DATABASE rebuilt LOCATION '{tmp_path}/rebuilt'")
    try:
        session.target.table("a").write.saveAsTable("rebuilt.a")
        source, target = (d.schema().table("a") for d in (session.source, session.target))
        made = rebuild.rebuild(source, target, session.target.schema(), ["test"])
        spark.catalog.setCurrentDatabase("rebuilt")
        for statement in made.sql().split(";\n"):
            spark.sql(statement).collect()
        assert [tuple(r) for r in spark.table("a").orderBy("id").collect()] == [(1, 10, 5, 10, 20, None), (2, 10, None, None, None, None)]
        assert [t.name for t in spark.catalog.listTables("rebuilt")] == ["a"]
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE rebuilt CASCADE")
