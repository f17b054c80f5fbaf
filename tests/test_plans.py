"""Driver-side planning: ordering, closures, sizes, schema comparison, scripts, guards, instances, collations."""

import io
import zipfile

from plumbline.model import Check, Column, ForeignKey, Key, Module, Schema, Sequence, Table, TypeSpec, UserType
from plumbline.operators.columns import declared_keys, resolve
from plumbline.plans import collation, guards, instances, ordering, schema_diff, script, sizes
from plumbline.plans.selection import DATABASE, ROW, TABLE, Exclusion, Plan, Selection, Unit, close_schema, compile_plan, normalise, schema_units

INT, TEXT = TypeSpec("int"), TypeSpec("string")


def table(name, *columns, parent=None, **more):
    cols = (Column("Id", INT, False, 0), *[c if isinstance(c, Column) else Column(c, TEXT, True, i + 1) for i, c in enumerate(columns)])
    keys = (ForeignKey(f"{name}_{parent}", ("Id",), parent, ("Id",)),) if parent else ()
    return Table(name, cols, ("Id",), foreign_keys=keys, **more)


def test_topological_order():
    order = ordering.topological(["d", "c", "b", "a"], {"d": ["b"], "c": ["d", "missing", "c"], "b": ["a"]})
    assert order.ordered == ("a", "b", "d", "c") and order.cyclic == ()
    order = ordering.topological(["x", "a", "b", "behind"], {"a": ["b"], "b": ["a"], "behind": ["a"]})
    assert order.ordered == ("x",) and order.cyclic == ("a", "b", "behind") and order.all[0] == "x"


def test_graph():
    tables = [table("line", parent="order"), table("order", parent="customer"), table("customer", parent="customer"), table("other", parent="gone")]
    graph = ordering.Graph(tables)
    assert graph.data_order().all == ("customer", "order", "line", "other")
    assert graph.ancestors("LINE") == ["order", "customer"]
    bands, edges = graph.neighbourhood("order", 9)
    assert dict(bands) == {"order": 0, "customer": -1, "line": 1} and ("order", "customer", "order_customer", False) in edges
    assert dict(graph.neighbourhood("order", 1, "children")[0]) == {"order": 0, "line": 1}
    assert script.data_order(tables)[0][0] == "other"


def test_sizes():
    t = sizes.TableSize
    assert sizes.row_range(t(10, 4, 1)) == (0, 10) and sizes.row_range(t(10, 4, 1, True, True)) == (6, 10) and sizes.row_range(t(5, 5, 1, True, True)) == (1, 5)
    assert sizes.row_range(t(10, 4, 1, True)) == (0, 0) and sizes.row_range(t(10, 4, 1, exact_rows=3)) == (3, 3)
    found = sizes.plan_size([t(1000, 0, 100, True, True), t(100, 100, 10), t(10, 0, 20, True, True)], 50, 10_000, 12_500)
    assert (found.staged, found.may_stage, found.not_scanned) == (1, 0, 1)
    assert (found.min_bytes, found.max_bytes, found.verdict) == (2048 + 0 + 100, 2048 + 2000 + 400, "Within")
    assert sizes.plan_size([t(0, 0, 0, exact_rows=100)], 0, 1000, 50).verdict == "Exceeds"
    assert sizes.delete_share(6, 100) and not sizes.delete_share(5, 100) and not sizes.delete_share(1, 0)
    assert sizes.transfer(2, 3, 4) == 480


def test_column_resolution():
    a = Table("t", (Column("Id", INT), Column("A", TEXT), Column("Made", TEXT, computed="1"), Column("V", TEXT, generated=True), Column("Gone", TEXT), Column("Skip", TEXT)))
    b = Table("t", (Column("ID", INT), Column("a", TEXT), Column("made", TEXT), Column("v", TEXT), Column("New", TEXT), Column("skip", TEXT)))
    found = resolve(a, b, ("id",), ["SKIP"])
    assert found.compared == ("A",) and found.can_compare
    assert dict(found.excluded) == {"Made": "computed", "V": "not comparable", "Gone": "only on source", "Skip": "excluded by rule", "New": "only on target"}
    assert not resolve(Table("t", (Column("Id", INT),)), b, ("id",)).can_compare
    held = Table("t", (Column("a", INT, False), Column("b", INT, False), Column("n", INT)), uniques=(Key("u", ("a", "b")), Key("v", ("n",))), indexes=(Key("i", ("b",)), Key("f", ("a",), filter="a > 1"), Key("p", ("a",), unique=False)))
    assert [k.name for k in declared_keys(held)] == ["i", "u"]


def test_schema_comparison():
    view = Module("View", "v", "create  view dbo.old as\n select 'a  b' -- it's\n from t", ("t",))
    same = Module("View", "v", "CREATE VIEW [v] as select 'a  b' -- it's\n from t", ("t",))
    source = Schema("s", (table("a", "x"), table("b"), table("c", Column("y", TypeSpec("decimal", precision=9, scale=2), True, 1))), (view,), (UserType("k", "Enum", "a,b"),), (Sequence("q", INT, increment=2),))
    target = Schema("t", (table("A", "X"), table("c", Column("y", TypeSpec("decimal", precision=9, scale=4), True, 1)), table("z")), (same,), (UserType("k", "Enum", "a,c"),), (Sequence("q", INT, start=5),))
    kinds = {(d.type, d.name): d.kind for d in schema_diff.schema_diff(source, target)}
    assert kinds == {("Table", "a"): "Same", ("Table", "b"): "SourceOnly", ("Table", "c"): "Different", ("Table", "z"): "TargetOnly", ("View", "v"): "Same", ("UserDefinedType", "k"): "Different", ("Sequence", "q"): "Different"}
    keyed = table("a", uniques=(Key("u", ("Id",)),), checks=(Check("c", "Id > 0"),))
    other = table("a", uniques=(Key("U", ("Id", "x")),), checks=(Check("c", "Id  >  0"),))
    assert [(c.type, c.kind) for c in schema_diff.table_diff(keyed, other).children] == [("UniqueConstraint", "Different")]
    ignored = schema_diff.schema_diff(Schema("s", (table("tmp.a"),)), Schema("t"), schema_diff.Options(ignored_schemas=("TMP",)))
    assert ignored == []


def test_bodies():
    assert schema_diff.normalise_body("a\n\t b 'x  y'  /* it's /* nested */ '  */ c") == "a b 'x  y' /* it's /* nested */ ' */ c"
    assert schema_diff.header("-- note\n/* x */ CREATE OR ALTER PROC [dbo].[p 1] as")[:2] == ("PROCEDURE", "dbo.p 1")
    assert schema_diff.header("select 1") is None


def narrow(old, new, nullable=(True, True)):
    return schema_diff.narrowing(Column("c", old, nullable[0]), Column("c", new, nullable[1])).kind


def test_narrowing():
    spec = TypeSpec
    assert narrow(INT, INT) == "None" and narrow(INT, INT, (True, False)) == "Converts"
    assert narrow(spec("varchar", is_max=True), spec("varchar", max_length=9)) == "Narrows"
    assert narrow(spec("varchar", max_length=9), spec("varchar", max_length=8)) == "Narrows" and narrow(spec("varchar", max_length=8), spec("VARCHAR", max_length=9)) == "None"
    assert narrow(spec("decimal", precision=9, scale=4), spec("decimal", precision=9, scale=2)) == "Narrows"
    assert narrow(spec("decimal", precision=9, scale=2), spec("decimal", precision=8, scale=2)) == "Narrows"
    assert narrow(spec("datetime2", precision=7), spec("datetime2", precision=3)) == "Narrows"
    assert narrow(spec("bigint"), INT) == "Narrows" and narrow(INT, spec("bigint"), (True, False)) == "Converts"
    assert narrow(spec("nvarchar"), spec("varchar")) == "Narrows" and narrow(spec("varchar"), spec("nvarchar")) == "None"
    assert narrow(INT, spec("date")) == "Converts" and narrow(spec("t", user_defined=True), INT) == "Converts"


def test_selection_and_closure():
    assert normalise([Selection(TABLE, "a"), Selection(ROW, "A", "1"), Selection(ROW, "b", "1"), Selection(TABLE, "a")]) == [Selection(TABLE, "a"), Selection(ROW, "b", "1")]
    assert normalise([Selection(TABLE, "a"), Selection(DATABASE)]) == [Selection(DATABASE)]
    units = [Unit("a", "Create"), Unit("b", "Alter"), Unit("b", "Data", "1"), Unit("A", "Create")]
    plan = compile_plan(units, [Selection(DATABASE)], [Exclusion("B", "Alter"), Exclusion("c", "Drop")])
    assert [u.id for u in plan.units] == ["Create:a", "Data:b:1"] and plan.exclusions == (Exclusion("B", "Alter"),)
    source = Schema("s", (table("line", parent="order"), table("order", parent="customer"), table("customer")), (Module("View", "v", "create view v as select 1", ("line",)),))
    diffs = schema_diff.schema_diff(source, Schema("t"))
    found = close_schema(Plan((Unit("v", "Create"),), ()), source, Schema("t"), diffs)
    assert [r[0] for r in found.required] == ["line", "order", "customer"]
    found = close_schema(Plan((Unit("line", "Create"),), (Exclusion("order", "Create"),)), source, Schema("t"), diffs)
    assert found.blocked == [("order", "line")] and not found.required
    lost = Schema("s", (table("a", parent="nowhere"),))
    assert close_schema(Plan((Unit("a", "Create"),), ()), lost, Schema("t"), schema_diff.schema_diff(lost, Schema("t"))).unsatisfiable


def test_script_and_package():
    source = Schema("s", (table("a", "x", parent="b"), table("b"), table("c", Column("n", INT))), (Module("View", "v2", "create view v2 as select * from v1", ("v1",)), Module("View", "v1", "create view v1 as select 1"), Module("Trigger", "t", "create trigger t")))
    target = Schema("t", (table("c", Column("n", TypeSpec("bigint")), "gone"), table("old")))
    diffs = schema_diff.schema_diff(source, target)
    made = script.schema_script(Plan(tuple(schema_units(diffs)), ()), source, target, diffs)
    steps = made.ordered()
    assert [script.PHASES.index(s.phase) for s in steps] == sorted(script.PHASES.index(s.phase) for s in steps)
    assert [s.object for s in steps if s.phase == "Programmables"] == ["v1", "v2"]
    assert {s.sql for s in made.destructive} == {"DROP TABLE `old`", "ALTER TABLE `c` DROP COLUMN `gone`", "ALTER TABLE `c` ALTER COLUMN `n` TYPE INT"}
    assert made.refusals == ["t: a trigger has no counterpart"] and "-- 1/" in made.text()
    assert script.package(made)[0] == "script.sql"
    name, data = script.package(made, {"a.csv": "1"})
    assert name == "script.zip" and set(zipfile.ZipFile(io.BytesIO(data)).namelist()) == {"script.sql", "data/a.csv", "README.txt"}


def test_guards():
    ok = guards.ApplyRequest("db", "Dev", "db", False)
    assert guards.blockers(ok) == []
    bad = guards.ApplyRequest("db", "Prod", "DB", False, ("drop",), tuple("abcdefg"), 0, 200 << 20)
    assert len(guards.blockers(bad)) == 5 + 5
    assert guards.classify("SQL-PRD-01", [("*dev*", "Dev"), ("*prd*", "Prod")]) == "Prod" and guards.classify("x", []) == "Unknown"


def test_instances():
    pairs, problems = instances.match(["A", "b", "c"], ["a", "B2", "d"], [("b", "b2"), ("B", "d"), ("", "x"), ("c", "nope")])
    assert [(p.source, p.target, p.kind) for p in pairs] == [("A", "a", "ByName"), ("b", "B2", "Declared"), ("c", None, "SourceOnly"), (None, "d", "TargetOnly")]
    assert len(problems) == 3
    D = instances.Described
    a = D(3, 2, 1, "ci")
    cases = [(None, None, "NotCompared"), (a, D(3, 2, 1, "CI"), "CountsMatch"), (a, D(3, 2, 2, "ci"), "CountsDiffer"), (a, D(3, 2, 2, "cs"), "CollationDiffers"), (a, D(problem="no"), "Unreadable"), (a, D(3, 2, 1, "ci", accessible=False), "Unreadable"), (D(state="OFFLINE"), a, "Unreadable")]
    for x, y, want in cases:
        assert instances.signal(instances.Pair("a", "a", "ByName"), x, y)[0] == want
    rows, problems = instances.survey({"A": a, "b": None}, {"a": a, "b": None, "c": a})
    assert [(p.source, s) for p, s, _ in rows] == [("A", "CountsMatch"), ("b", "NotCompared"), (None, "TargetOnly")] and len(problems) == 1
    assert "declare" in instances.survey({"x": a}, {"y": a})[1][0]


def test_collations():
    known = collation.KNOWN | {"l1": collation.Collation("L1", 1252, "ci", False), "l2": collation.Collation("L2", 1250, "ci", False)}
    make = lambda *c: Table("t", tuple(Column(n, TEXT, collation=x) for n, x in zip("kab", c)))
    found = collation.findings(make("UNICODE", "UTF8_BINARY", "L1"), make("UNICODE_CI", "UTF8_LCASE", "L2"), ("k",), ("a", "b"), known)
    assert [(f.column, f.risk) for f in found] == [("k", "Blocking"), ("a", "Advisory"), ("b", "Blocking")] and collation.blocked(found)
    assert collation.findings(make(None, "x", "UNICODE"), make("UNICODE", "X", "unicode"), ("k",), ("a", "b")) == []
    assert collation.findings(make("lost", None, None), make("UNICODE", None, None), ("k",), ())[0].risk == "Blocking"


def test_tables_are_created_with_their_keys_and_altered_in_every_respect():
    from plumbline.model import Column, ForeignKey, Key, Schema, Table, TypeSpec
    from plumbline.plans import schema_diff, script, selection

    text, number = TypeSpec("string"), TypeSpec("int")
    fk = ForeignKey("to_p", ("p",), "p", ("id",), "CASCADE", "SET NULL")
    made = Table("n", (Column("id", number, False), Column("p", number)), ("id",), (Key("once", ("p",)),), (Key("ix", ("p",), False),), (fk,))
    new = Table("t", (Column("a", text, False, default="'x'"), Column("b", text, collation="UNICODE_CI"), Column("c", number)))
    old = Table("t", (Column("a", text), Column("b", text), Column("c", number, False)))
    source, target = Schema("s", (made, new)), Schema("t", (old,))
    diffs = schema_diff.schema_diff(source, target, schema_diff.Options())
    plan = selection.compile_plan(selection.schema_units(diffs), [selection.Selection(selection.DATABASE)], [])
    out = script.schema_script(plan, source, target, diffs)
    sql = out.text()
    for part in ("PRIMARY KEY (`id`)", "CONSTRAINT `once` UNIQUE (`p`)", "REFERENCES `p` (`id`) ON DELETE CASCADE ON UPDATE SET NULL", "ALTER COLUMN `a` SET NOT NULL", "ALTER COLUMN `a` SET DEFAULT 'x'", "ALTER COLUMN `b` TYPE STRING COLLATE UNICODE_CI", "ALTER COLUMN `c` DROP NOT NULL", "n.ix: an index has no counterpart"):
        assert part in sql, (part, sql)
    assert "ALTER COLUMN `a` TYPE" not in sql


def _keyed():
    from plumbline.model import Check, ForeignKey, Key, Module, Schema

    number = TypeSpec("int")
    top = Table("top", (Column("id", number, False),), ("id",))
    mid = Table(
        "mid", (Column("id", number, False), Column("top", number, False), Column("code", number, default="1"), Column("twice", number, computed="code * 2"), Column("more", number, computed="[twice] + 1")),
        ("id",), (Key("u", ("code",)),), (Key("ix", ("top",), False, "code > 1"),), (ForeignKey("to_top", ("top",), "top", ("id",)),), (Check("positive", "CODE > 0"), Check("other", "top <> 'code'")),
    )
    low = Table("low", (Column("id", number, False), Column("code", number)), ("id",), (), (), (ForeignKey("to_mid", ("code",), "mid", ("code",)),))
    loop = Table("loop", (Column("id", number, False), Column("low", number)), ("id",), (), (), (ForeignKey("to_low", ("low",), "low", ("id",)),))
    return Schema("s", (top, mid, low, loop), (Module("VIEW", "v", "CREATE VIEW v AS SELECT code FROM mid", ("mid",)),))


def test_dependents_of_a_column():
    from plumbline.plans.dependents import dependents

    schema = _keyed()
    found = dependents(schema, schema.table("mid"), ["Code"])
    assert [c.name for c in found.computed] == ["twice", "more"] and [c.name for c in found.defaults] == ["code"]
    assert [k.name for k in found.indexes] == ["ix"] and [k.name for k in found.uniques] == ["u"] and found.primary_key == ()
    assert [c.name for c in found.checks] == ["positive"] and found.outbound == () and [(t, k.name) for t, k in found.inbound] == [("low", "to_mid")] and found.modules == ("v",)
    assert [k.name for k in dependents(schema, schema.table("mid"), ["top"]).outbound] == ["to_top"]
    assert dependents(schema, schema.table("top"), [], [("ID",)]).inbound[0][0] == "mid"


def test_keys_are_bracketed_round_a_changed_column():
    from dataclasses import replace

    from plumbline.plans import schema_diff, script, selection

    source = target = _stored(_keyed())
    mid = source.table("mid")
    columns = tuple(replace(c, type=TypeSpec("bigint")) if c.name == "code" else c for c in mid.columns)
    source = replace(source, tables=tuple(replace(mid, columns=columns, checks=(*mid.checks, Check("new", "id > 0"))) if t.name == "mid" else t for t in source.tables))
    made = _scripted(source, target)
    sql = [s.sql for s in made.ordered()]
    at = lambda part: next(i for i, s in enumerate(sql) if part in s)
    assert at("`low` DROP CONSTRAINT `to_mid`") < at("TYPE BIGINT") < at("`low` ADD CONSTRAINT `to_mid`")
    assert at("`low` DROP CONSTRAINT `to_mid`") < at("DROP CONSTRAINT `u`") < at("TYPE BIGINT") < at("ADD CONSTRAINT `u` UNIQUE (`code`)")
    assert at("DROP CONSTRAINT `positive`") < at("TYPE BIGINT") < at("ADD CONSTRAINT `positive` CHECK") and at("ADD CONSTRAINT `new` CHECK (id > 0)")
    assert at("`code` DROP DEFAULT") < at("TYPE BIGINT") < at("`code` SET DEFAULT 1")
    assert not made.refusals and any(w.startswith("v reads mid") for w in made.warnings) and any("mid.ix" in w for w in made.warnings)


def _stored(schema):
    """Without computed columns."""
    from dataclasses import replace

    return replace(schema, tables=tuple(replace(t, columns=tuple(c for c in t.columns if not c.computed)) for t in schema.tables))


def _scripted(source, target, excluded=()):
    from plumbline.plans import schema_diff, script, selection

    diffs = schema_diff.schema_diff(source, target, schema_diff.Options())
    plan = selection.compile_plan(selection.schema_units(diffs), [selection.Selection(selection.DATABASE)], list(excluded))
    return script.schema_script(plan, source, target, diffs)


def _with(schema, **tables):
    """The schema with tables replaced, or left out where None."""
    from dataclasses import replace

    changed = [tables.get(t.name, t) for t in schema.tables]
    return replace(schema, tables=tuple(t for t in changed if t is not None))


def _retyped(table, *names):
    from dataclasses import replace

    return replace(table, columns=tuple(replace(c, type=TypeSpec("bigint")) if c.name in names else c for c in table.columns))


def test_a_key_between_two_changed_tables_goes_and_comes_once():
    base = _stored(_keyed())
    source = _with(base, mid=_retyped(base.table("mid"), "code"), low=_retyped(base.table("low"), "code"))
    sql = [s.sql for s in _scripted(source, base).ordered()]
    for verb in ("DROP", "ADD"):
        assert sum(f"`low` {verb} CONSTRAINT `to_mid`" in s for s in sql) == 1
    assert sum("TYPE BIGINT" in s for s in sql) == 2


def test_a_key_that_the_plan_drops_or_changes_itself_is_left_to_it():
    from dataclasses import replace

    base = _stored(_keyed())
    low = base.table("low")
    gone = _scripted(_with(base, mid=_retyped(base.table("mid"), "code"), low=replace(low, foreign_keys=())), base).text()
    assert gone.count("DROP CONSTRAINT `to_mid`") == 1 and "ADD CONSTRAINT `to_mid`" not in gone
    other = replace(low, foreign_keys=(replace(low.foreign_keys[0], on_delete="CASCADE"),))
    text = _scripted(_with(base, mid=_retyped(base.table("mid"), "code"), low=other), base).text()
    assert text.count("DROP CONSTRAINT `to_mid`") == 1 and text.count("ADD CONSTRAINT `to_mid`") == 1 and "ON DELETE CASCADE" in text
    dropped = _scripted(_with(base, mid=_retyped(base.table("mid"), "code"), low=None, loop=None), base).text()
    assert "to_mid" not in dropped and "DROP TABLE `low`" in dropped


def test_dropped_columns_take_what_holds_them_or_are_refused():
    from dataclasses import replace

    base = _stored(_keyed())
    mid, low = base.table("mid"), base.table("low")
    without = replace(mid, columns=tuple(c for c in mid.columns if c.name != "code"), uniques=(), indexes=(), checks=mid.checks[1:])
    free = replace(low, foreign_keys=())
    sql = [s.sql for s in _scripted(_with(base, mid=without, low=free), base).ordered()]
    at = lambda part: next(i for i, s in enumerate(sql) if part in s)
    assert at("DROP CONSTRAINT `to_mid`") < at("DROP CONSTRAINT `u`") < at("DROP COLUMN `code`") and not any("ADD CONSTRAINT" in s for s in sql)
    assert sum("DROP CONSTRAINT `u`" in s for s in sql) == sum("DROP CONSTRAINT `positive`" in s for s in sql) == 1
    # the other table keeps its key, which then has nothing to refer to
    assert "low.to_mid: it refers to what the plan takes from mid" in _scripted(_with(base, mid=without), base).refusals[0]


def test_computed_and_identity_changes_and_primary_keys_rebuild_the_table():
    from dataclasses import replace

    base = _keyed()
    mid, top = base.table("mid"), base.table("top")
    made = _scripted(_with(base, mid=_retyped(mid, "code")), base)
    assert set(made.rebuilds) == {"mid"} and "computed from what changes" in made.rebuilds["mid"].why[0] and not any("rebuilt" in r for r in made.refusals)
    assert made.rebuilds["mid"].columns["more"] == ("INT", "(code * 2) + 1") and made.rebuilds["mid"].columns["code"] == ("BIGINT", "`code`")
    sql = [s.sql for s in made.ordered()]
    at = lambda part: next(i for i, s in enumerate(sql) if part in s)
    assert at("`low` DROP CONSTRAINT `to_mid`") < at("CREATE TABLE `mid__copy` AS SELECT") < at("ADD PRIMARY KEY (`id`)") < at("`low` ADD CONSTRAINT `to_mid`")
    assert sum("CONSTRAINT `u`" in s for s in sql) == sum("CONSTRAINT `to_top`" in s for s in sql) == 1  # only put on the copy
    # a key of two rebuilt tables goes once and comes with the child's copy
    numbered = lambda t: replace(t, columns=tuple(replace(c, identity="(1,1)") if c.name == "id" else c for c in t.columns))
    both = _scripted(_with(base, mid=numbered(mid), top=numbered(top)), base)
    assert set(both.rebuilds) == {"mid", "top"}
    for verb in ("DROP", "ADD"):
        assert both.text().count(f"`mid` {verb} CONSTRAINT `to_top`") == 1
    assert any("mid.id: numbers are kept" in w for w in both.warnings)
    rekeyed = _scripted(_with(base, top=replace(top, columns=(*top.columns, Column("b", TypeSpec("int"))), primary_key=("id", "b"))), base)
    assert "its primary key changes" in rekeyed.rebuilds["top"].why


def test_what_stands_against_a_rebuild_is_named():
    from dataclasses import replace

    from plumbline.model import Module

    base = _keyed()
    mid = base.table("mid")
    bound = replace(base, modules=(Module("VIEW", "w", "CREATE VIEW w WITH SCHEMABINDING AS SELECT id FROM mid", ("mid",)),))
    stored = _with(bound, mid=replace(mid, storage=("versioned",)))
    source = _with(bound, mid=replace(_retyped(mid, "code"), columns=(*_retyped(mid, "code").columns, Column("must", TypeSpec("int"), False))))
    made = _scripted(source, stored)
    refusal = next(r for r in made.refusals if "can't be rebuilt" in r)
    assert "lose that it is versioned" in refusal and "w can't be without it" in refusal and "nothing for must" in refusal
    assert not made.rebuilds and not any("`mid`" in s.sql and "ALTER COLUMN" in s.sql for s in made.steps)


def test_indexes_statistics_storage_and_keys_of_types_are_told_apart():
    from dataclasses import replace

    from plumbline.model import Key, Schema, UserType
    from plumbline.plans import schema_diff

    number = TypeSpec("int")
    old = Table("t", (Column("a", number), Column("b", number)), (), (), (Key("ix", ("a",), False),), statistics=(Key("st", ("a",), False),))
    new = replace(old, indexes=(Key("ix", ("a",), False, None, ("b",), "columnstore"),), statistics=(Key("st", ("a", "b"), False),), storage=("partitioned",))
    source, target = Schema("s", (new,), types=(UserType("list", "table", "a int", ("PRIMARY KEY (a)",)),)), Schema("t", (old,), types=(UserType("list", "table", "a int"),))
    by = {d.name: d for d in schema_diff.schema_diff(source, target)}
    assert {(c.type, p.name) for c in by["t"].children for p in c.properties} == {("Index", "Included"), ("Index", "Kind"), ("Statistics", "Columns")}
    assert by["t"].properties[0].source == "partitioned" and by["list"].properties[0].name == "Keys"
    refusals = _scripted(source, target).refusals
    assert any("t.ix" in r and "columnstore index on a including b" in r and "stored by columns" in r for r in refusals)


def test_fk_map_and_words():
    from dataclasses import replace

    from plumbline.plans import detail, fk_map, schema_diff

    source = _keyed()
    target = replace(source, tables=(source.tables[0], replace(source.tables[1], checks=()), *source.tables[3:]))
    diffs = schema_diff.schema_diff(source, target, schema_diff.Options())
    found = fk_map.fk_map(source, target, diffs, "MID", 2, "parents")
    assert [(n.table, n.band, n.state) for n in found.nodes] == [("top", -1, "Untouched"), ("mid", 0, "Focus")] and found.nodes[1].note == "the plan changes it"
    assert [(e.child, e.parent, e.nullable, e.in_cycle) for e in found.edges] == [("mid", "top", False, False)]
    assert [n.partition(":")[0] for n in found.notes] == ["have rows that lean on mid, and on all of it", "every row of mid needs a row of", "not drawn in this direction, still in the way of the plan"]
    assert found.notes[0].endswith(": low, loop") and found.cyclic == ()
    assert fk_map.fk_map(source, replace(target, tables=()), diffs, "mid", 1).notes[:2] == ("every row of mid needs a row of: top", "new on the target, so nothing there can be compared: mid")
    assert [n.state for n in fk_map.fk_map(source, target, diffs, "mid", 1).nodes] == ["Untouched", "Focus", "InPlan"]
    by = {d.name: detail.summary(d) for d in diffs}
    assert by["mid"] == "not alike: CheckConstraint x2" and by["low"] == "missing on the target" and by["top"] == "alike"
    assert "  FOREIGN KEY to_top (top) REFERENCES top (id)\n" in detail.sketch(source.table("mid")) and "  id INT NOT NULL\n" in detail.sketch(source.table("top"))


def test_collations_are_asked_of_the_source_first(spark):
    asked = []

    def asker(name, knows):
        def ask(names):
            asked.append((name, names))
            return {n: collation.Collation(n, 65001, name) for n in names if n in knows}

        return ask

    found = collation.facts(["A", "b", "a", "c"], asker("source", {"a"}), asker("target", {"a", "b"}))
    assert asked == [("source", ["a", "b", "c"]), ("target", ["b", "c"])] and {n: c.style for n, c in found.items()} == {"a": "source", "b": "target"}
    real = collation.read_collations(spark, ["de_CI", "UNICODE_CI", "nowhere"])
    assert set(real) == {"de_ci", "unicode_ci"} and real["de_ci"].style.startswith("ci_as_german") and collation.read_collations(spark, []) == {}
    F_ = collation.Finding
    assert collation.told({"t": [F_("a", "Blocking", "x")], "u": [F_("b", "Advisory", "y")]}, "p", "q") == ["not compared for their collations: t", "1 columns order or fold texts differently; rows are matched by their very characters, so none of that changes a result"]
    assert "default to p and q" in collation.told({}, "p", "q")[0] and collation.told({}, "p", "P") == []


def test_names_stand_where_tables_and_routines_do():
    from plumbline.sources.catalog import names_in

    body = """CREATE VIEW v AS /* FROM hidden */ SELECT t.a, dbo.f(t.b), 'FROM text' -- JOIN gone
    FROM [t] x, `u`.`w` AS y, (SELECT * FROM inner_one i, other) z JOIN "q" ON x.a = q.a, last_one WHERE a IN (SELECT b FROM deep) ORDER BY c, d"""
    assert names_in(body) == ["dbo.f", "t", "u.w", "inner_one", "other", "q", "IN", "deep"]
    assert names_in("UPDATE a SET b = 1, c = 2; INSERT INTO d VALUES (1, e); EXEC p") == ["a", "d", "p"]


def test_types_become_spark_types_and_come_back():
    from pyspark.sql.types import DataType

    for name in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string", "binary", "date", "timestamp", "timestamp_ntz", "decimal(18,2)", "array<float>", "struct<a:int,b:string>", "map<string,int>"):
        kind = DataType.fromDDL(name)
        assert TypeSpec.of(kind).spark() == kind
    for spec, name in ((TypeSpec("NVARCHAR", 50), "string"), (TypeSpec("numeric", precision=9, scale=3), "decimal(9,3)"), (TypeSpec("datetime2", scale=7), "timestamp_ntz"), (TypeSpec("bit"), "boolean"), (TypeSpec("money"), "decimal(19,4)")):
        assert spec.spark().simpleString() == name
    import pytest

    with pytest.raises(ValueError, match="no Spark type holds GEOGRAPHY_X"):
        TypeSpec("geography_x").spark()
