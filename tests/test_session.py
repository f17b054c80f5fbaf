"""A comparison from scan to applied change."""

import json

import pytest

from plumbline.functions.predicate import Refusal
from plumbline.model import Column, Key, TypeSpec
from plumbline.plans.guards import Limits
from plumbline.plans.selection import DATABASE, Selection
from plumbline.session import CompareSession, NotComparable, TableChoice
from plumbline.sources.catalog import ParquetDatabase
from plumbline.sources.snapshot import SnapshotTable


@pytest.fixture
def session(spark, tmp_path):
    sides = {
        "source": {"category": [(1, "Retail"), (2, "Wholesale"), (3, "Energy")], "company": [(1, "A", 1), (2, "B", 3)], "keyless": [(1, "x", 1), (1, "y", 2)]},
        "target": {"category": [(1, "Retail"), (2, "Wholesale Ltd"), (4, "Obsolete")], "company": [(1, "A", 1)], "keyless": [(1, "x", 1)]},
    }
    keys = {"category": {"primary_key": ["id"]}, "company": {"primary_key": ["id"], "foreign_keys": [{"name": "fk", "columns": ["category"], "parent": "category", "parent_columns": ["id"]}]}}
    for side, tables in sides.items():
        for name, rows in tables.items():
            schema = "id int, name string" + ("" if name == "category" else ", category int")
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{side}/{name}.parquet")
        (tmp_path / side / "constraints.json").write_text(json.dumps(keys))
    return CompareSession(*[ParquetDatabase(spark, f"{tmp_path}/{s}") for s in sides])


def test_scan_compare_and_keys(session):
    assert {r.table_name: r.state for r in session.scan().collect()} == {"category": "differs", "company": "differs", "keyless": "not comparable"}
    found = session.compare("category")
    assert found["counts"] == {"Same": 1, "Update": 1, "Insert": 1, "Delete": 1} and found["cells"].count() == 1 and found["transfer"] == 48
    with pytest.raises(NotComparable, match="no primary key"):
        session.compare("keyless")
    assert session.key_options("keyless")["recommended"] == ("name",)
    with pytest.raises(NotComparable, match="different keys"):
        session.choose_key("keyless", ("id",))
    session.choose_key("keyless", ("name",))
    assert session.compare("keyless")["counts"] == {"Same": 1, "Insert": 1}
    with pytest.raises(Refusal):
        session.select("category", TableChoice("Filter", predicate="rand() > 1"))
    assert session.compare("category", TableChoice("Filter", predicate="LEN(name) > 6"))["counts"] == {"Update": 1}


def test_script_needs_parents_and_apply_converges(spark, session, tmp_path):
    session.select("company", TableChoice())
    changes = session.changes()
    assert session.closure(changes).required == [("category", 1, "company", "fk")]
    session.selections.append(Selection(DATABASE))
    text = session.script().text()
    assert "INSERT INTO `company` (`id`, `name`, `category`) VALUES\n(2, 'B', 3)" in text
    tables = {}
    for name in ("category", "company"):
        tables[name] = SnapshotTable(spark, f"{tmp_path}/versions/{name}")
        tables[name].write(session.target.table(name))
    assert session.apply(tables, "Prod", "wrong")["outcome"] == "Blocked"
    done = session.apply(tables, "Dev", "target")
    assert done["outcome"] == "Applied" and set(done["done"]) == {"category", "company"}
    assert {tuple(r) for r in tables["company"].read().collect()} == {(1, "A", 1), (2, "B", 3)}
    assert 3 in {r.id for r in tables["category"].read().collect()}
    assert session.drift() == []


def test_parents_are_scripted_and_written_beside_picked_rows(spark, session, tmp_path):
    session.select("company", TableChoice())
    text = session.script().text()
    assert text.index("INSERT INTO `category` (`id`, `name`) VALUES\n(3, 'Energy')") < text.index("INSERT INTO `company`")
    session.select("category", TableChoice(picks=spark.createDataFrame([(2,)], "id int")))
    text = session.script().text()
    assert "(3, 'Energy')" in text and "'Wholesale'" in text and "DELETE" not in text
    tables = {}
    for name in ("category", "company"):
        tables[name] = SnapshotTable(spark, f"{tmp_path}/versions/{name}")
        tables[name].write(session.target.table(name))
    session.limits = Limits(closure_rows=0)
    assert session.apply(tables, "Dev", "target")["outcome"] == "Blocked"
    session.limits = Limits()
    assert session.apply({"company": tables["company"]}, "Dev", "target")["outcome"] == "Blocked"
    assert session.apply(tables, "Dev", "target")["outcome"] == "Applied"
    assert {tuple(r) for r in tables["category"].read().collect()} == {(1, "Retail"), (2, "Wholesale"), (3, "Energy"), (4, "Obsolete")}


def test_schema_script_creates_what_is_needed(spark, session, tmp_path):
    spark.createDataFrame([(1, 1)], "id int, branch int").write.parquet(f"{tmp_path}/source/site.parquet")
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{tmp_path}/source/branch.parquet")
    keys = {"site": {"primary_key": ["id"], "foreign_keys": [{"name": "to_branch", "columns": ["branch"], "parent": "branch", "parent_columns": ["id"]}]}, "branch": {"primary_key": ["id"]}}
    (tmp_path / "source" / "constraints.json").write_text(json.dumps(keys))
    session = CompareSession(*[ParquetDatabase(spark, f"{tmp_path}/{s}") for s in ("source", "target")])
    session.selections.append(Selection("Table", "site"))
    assert {s.object for s in session.script().steps if s.phase == "CreateTables"} == {"site", "branch"}


def test_what_was_reviewed_stays_as_it_was(spark, session, tmp_path):
    session.select("category", TableChoice())
    tables = {"category": SnapshotTable(spark, f"{tmp_path}/versions/category")}
    tables["category"].write(session.target.table("category"))
    assert "reviewed" in str(session.apply(tables, "Dev", "target", True)["why"])  # no script yet
    session.script()
    rows = [(1, "Retail"), (2, "Wholesale"), (4, "Gone"), (9, "New")]
    spark.createDataFrame(rows, "id int, name string").write.mode("overwrite").parquet(f"{tmp_path}/target/category.parquet")
    assert session.drift() == ["category: 1 moved, 1 settled, 1 appeared"]
    assert session.apply(tables, "Dev", "target", True)["outcome"] == "Blocked"
    session.script()
    session.limits = Limits(script_bytes=10)
    assert any("larger than 10 bytes" in w for w in session.apply(tables, "Dev", "target", True)["why"])


def test_drift_tells_keys_apart(spark):
    from plumbline.operators import drift

    rows = [("a, b", "c", "Update", "1"), ("a", "b, c", "Update", "2"), (None, "x", "Update", "3"), ("NULL", "x", "Update", "4")]
    found = spark.createDataFrame(rows, "p string, q string, classification string, target_hash string")
    state = drift.snapshot(found, "t", ["p", "q"])
    assert drift.drift(state, state).collect() == []


def test_a_table_that_fails_while_read_takes_only_itself_down(spark, session, tmp_path):
    parts = sorted((tmp_path / "source" / "company.parquet").glob("part-*"))
    for some in ([max(parts, key=lambda p: p.stat().st_size)], parts):  # one that holds rows, then all, the schema too
        for path in some:
            path.write_bytes(b"PAR1" + b"x" * 50 + b"PAR1")
        states = {r.table_name: (r.state, r.reason) for r in session.scan(again=True).collect()}
        assert states["category"][0] == "differs" and states["company"][0] == "not comparable" and "could not be read" in states["company"][1]


def test_selection_volumes_details_and_cached_scan(spark, session, tmp_path):
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{tmp_path}/source/fresh.parquet")
    session = CompareSession(session.source, session.target)
    assert session.tick("fresh")["selected"] == ["fresh"] and session.set_scope(True)["scope"] == "Database"
    state = session.tick("fresh", False)
    assert state["selected"] == [] and [e.object for e in state["exclusions"]] == ["fresh"]
    assert session.tick("fresh")["selected"] == ["fresh"] and session.set_scope(False) == session.selection_state() and session.exclusions == []
    with pytest.raises(ValueError):
        session.tick("category")
    volumes = {r["table"]: r for r in session.volumes()}
    assert volumes["company"]["source_rows"] == 2 and volumes["company"]["target_rows"] == 1 and volumes["keyless"]["key_state"] == "none" and not volumes["fresh"]["on_target"]
    assert session.detail("fresh")["summary"] == "missing on the target" and session.detail("fresh")["target"] is None
    first = session.scan().collect()
    spark.createDataFrame([(9, "new")], "id int, name string").write.mode("append").parquet(f"{tmp_path}/target/category.parquet")
    assert session.scan().collect() == first and session.fk_map("company").nodes[0].table == "category"
    assert session.scan(again=True).count() == len(first)


def test_notes_on_columns_and_collations(spark, session):
    notes = session.key_options("keyless")["notes"]
    assert notes == {"id": "1 values in 2 rows", "name": "another value in every row", "category": "another value in every row"}
    note, a, b = session._key_note, Column("a", TypeSpec("int"), False), Column("b", TypeSpec("int"))
    held = [Key("u", ("A",)), Key("w", ("c", "b"))]
    assert (note(a, held, None), note(b, held, None), note(b, [], None), note(a, [], None)) == ("a key by u", "part of the key by w", "may be null", "not measured")
    assert note(b, [], {"null_count": 2, "row_count": 5, "distinct_count": 3, "could_be_key": False}) == "null in 2 of 5 rows"
    assert session.collation_warnings() == [] and set(session.collation_facts()) <= {"utf8_binary"}
