"""Row compare, screening, keys, closure, drift, applying."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plumbline.model import ForeignKey
from plumbline.operators import closure, compare, drift, keys, screen
from plumbline.operators.compare import CompareRequest

CATEGORY = "id int, name string"
SOURCE = [(1, "Retail"), (2, "Wholesale"), (3, "Energy")]
TARGET = [(1, "Retail"), (2, "Wholesale Ltd"), (4, "Obsolete")]


def classified(source, target, request, **more):
    return {tuple(r)[: len(request.keys)]: r.classification for r in compare.classify(source, target, request, **more).collect()}


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame(SOURCE, CATEGORY), spark.createDataFrame(TARGET, CATEGORY)


def test_all_rows(pair):
    assert classified(*pair, CompareRequest(("id",))) == {(1,): "Same", (2,): "Update", (3,): "Insert", (4,): "Delete"}


def test_swap_exchanges_insert_and_delete(pair):
    back = classified(pair[1], pair[0], CompareRequest(("id",)))
    assert back == {(1,): "Same", (2,): "Update", (3,): "Delete", (4,): "Insert"}


def test_top_and_filter_suppress_deletes(pair):
    assert classified(*pair, CompareRequest(("id",), mode="TopN", top=2)) == {(1,): "Same", (2,): "Update"}
    assert classified(*pair, CompareRequest(("id",), mode="Filter", predicate="id > 1")) == {(2,): "Update", (3,): "Insert"}


def test_filter_tells_rows_whose_copy_is_left_out(pair):
    rows = compare.classify(*pair, CompareRequest(("id",), mode="Filter", predicate="name = 'Wholesale'"), extra=True).collect()
    assert [(r.classification, r.key_exists_on_target) for r in rows] == [("Insert", True)]


def test_schema_only_and_bad_requests(pair):
    assert classified(*pair, CompareRequest(("id",), mode="SchemaOnly")) == {}
    for bad in ({"keys": ()}, {"keys": ("id",), "mode": "Filter", "predicate": " "}, {"keys": ("id",), "mode": "No"}, {"keys": ("id",), "mode": "TopN", "top": 0}):
        with pytest.raises(ValueError):
            CompareRequest(**bad)


def test_empty_sides(spark, pair):
    none = spark.createDataFrame([], CATEGORY)
    assert set(classified(none, pair[1], CompareRequest(("id",))).values()) == {"Delete"}
    assert set(classified(pair[0], none, CompareRequest(("id",))).values()) == {"Insert"}
    assert classified(none, none, CompareRequest(("id",))) == {}


def test_duplicate_keys_are_refused_by_side(spark, pair):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], CATEGORY)
    with pytest.raises(compare.DuplicateKeys, match=r"the source has 2 rows of key \(1\)"):
        compare.collected(compare.classify(twice, pair[1], CompareRequest(("id",))))
    with pytest.raises(compare.DuplicateKeys, match="the target has 2"):
        compare.collected(compare.counts(compare.classify(pair[0], twice, CompareRequest(("id",)))))
    assert len(compare.classify(twice, pair[1], CompareRequest(("id",)), check_keys=False).collect()) == 3


def test_a_compare_is_one_exchange_and_runs_nothing_while_built(spark, tmp_path):
    schema = "a int, b string, c string, d double"
    for side in ("s", "t"):
        spark.createDataFrame([(1, "x", "y", 1.0), (None, None, "z", 2.0)], schema).write.parquet(f"{tmp_path}/{side}")
    sides = [spark.read.parquet(f"{tmp_path}/{s}") for s in ("s", "t")]
    for request, extra in ((CompareRequest(("a", "b")), False), (CompareRequest(("a", "b"), mode="Filter", predicate="d > 0"), False), (CompareRequest(("a", "b"), mode="Filter", predicate="d > 0"), True)):
        group = f"built {request.mode} {extra}"
        spark.sparkContext.setJobGroup(group, "")
        found = compare.classify(*sides, request, extra=extra)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1 and "Join" not in plan and "Sort" not in plan
        assert {r.classification for r in found.collect()} == {"Same"}
    spark.sparkContext.setJobGroup("other", "")


def test_only_the_target_s_width_decides_whether_wanted_keys_are_sent_to_all(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda top: compare.classify(rows, rows, CompareRequest(("id",), mode="TopN", top=top))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(100) and "BroadcastHashJoin" not in plan(100_000_000)


def test_null_empty_and_position_differ(spark):
    schema = "id int, a string, b string, x double"
    rows = [(1, None, "x", -25.0), (2, "x", None, 25.0), (3, "", "x", None), (None, "n", "n", float("nan")), (5, "q'\n😀", "\\", 1e39)]
    other = [(1, "", "x", -25.0), (2, None, "x", 25.0), (3, "", "x", None), (None, "n", "n", float("nan")), (5, "q'\n😀", "\\", 1e39)]
    found = classified(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), CompareRequest(("id",)))
    assert found == {(1,): "Update", (2,): "Update", (3,): "Same", (None,): "Same", (5,): "Same"}


def test_changes_picks_and_apply_converge(spark, pair):
    request = CompareRequest(("id",))
    changes = compare.changes(*pair, request)
    assert {(r.id, r.op, r.name) for r in changes.collect()} == {(2, "Update", "Wholesale"), (3, "Insert", "Energy"), (4, "Delete", None)}
    after = compare.apply_changes(pair[1], changes, ["id"])
    assert set(classified(pair[0], after, request).values()) == {"Same"}
    picks = spark.createDataFrame([(3,), (9,)], "id int")
    assert [r.id for r in compare.changes(*pair, request, picks).collect()] == [3]
    assert [r.id for r in compare.unmatched_picks(picks, changes, ["id"]).collect()] == [9]
    assert compare.changes(*pair, request, picks.limit(0)).collect() == []
    with pytest.raises(ValueError):
        compare.changes(*pair, CompareRequest(("id",), mode="TopN"), picks)


def test_cells(pair):
    assert [tuple(r) for r in compare.cell_diffs(*pair, CompareRequest(("id",))).collect()] == [(2, "name", "Wholesale", "Wholesale Ltd")]


def test_the_screen_agrees_with_the_compare(spark, pair):
    request = CompareRequest(("id",))
    other = pair[0].repartition(3).orderBy(F.desc("id"))
    for target in (pair[0], pair[1], other, pair[0].limit(0)):
        state = screen.screen({"t": pair[0]}, {"t": target}, {"t": ("id",)}).first().state
        same = set(classified(pair[0], target, request).values()) <= {"Same"}
        assert state == ("same" if same else "differs")


def test_screen_reasons(spark, pair):
    a, b = pair
    found = screen.screen({"a": a, "b": a, "c": a, "e": a.select("id")}, {"a": b, "c": b, "d": b, "e": b.select("id")}, {"a": ("id",), "e": ("id",)}, {"a": 9}, 5)
    assert {r.table_name: (r.state, r.reason) for r in found.collect()} == {
        "a": ("skipped", "larger than 5 bytes"), "b": ("not comparable", "only on source"), "c": ("not comparable", "no primary key"),
        "d": ("not comparable", "only on target"), "e": ("not comparable", "no comparable columns"),
    }


def test_keys(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y")], "id int, g string, n string")
    rows = {r.column_name: (r.distinct_count, r.null_count, r.could_be_key) for r in keys.profile(df).collect()}
    assert rows == {"id": (3, 0, True), "g": (2, 0, False), "n": (2, 1, False)}
    assert not any(r.could_be_key for r in keys.profile(df.limit(0)).collect())
    assert tuple(keys.check_key(df, ["g", "n"]).first()) == (3, 3, 1, False)
    assert tuple(keys.check_key(df, ["id"]).first()) == (3, 3, 0, True)
    assert keys.verdict(3, 2, 1).startswith("1 of 3") and "2 different" in keys.verdict(3, 2, 0) and keys.verdict(3, 3, 0) is None
    assert keys.recommend([("a", "b"), ("c",)], [("id", True)]) == ("c",) and keys.recommend([], [("g", False), ("id", True)]) == ("id",) and keys.recommend([], []) == ()


def test_closure(spark):
    tables = {
        "site": spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 99)], "id int, region int"),
        "region": spark.createDataFrame([(10, 100), (11, 11), (12, 100)], "id int, part_of int"),
    }
    tables["region"] = tables["region"].unionByName(spark.createDataFrame([(100, None)], "id int, part_of int"))
    links = {"site": [ForeignKey("site_region", ("region",), "region", ("id",))], "region": [ForeignKey("part", ("part_of",), "region", ("id",))]}
    empty = {"region": tables["region"].limit(0)}
    found = closure.close({"site": tables["site"]}, tables, empty, links)
    assert {r.id for r in found.added["region"].collect()} == {10, 11, 100}
    assert found.required[0] == ("region", 2, "site", "site_region") and any("neither side" in w for w in found.warnings)
    assert closure.close({"site": tables["site"].where("id = 1")}, tables, {"region": tables["region"]}, links).added == {}
    capped = closure.close({"site": tables["site"]}, tables, empty, links, max_rows=1)
    assert capped.added == {} and "beyond 1 rows" in capped.warnings[0]
    assert {r.id for r in closure.orphans(tables["site"], links["site"][0], tables["region"]).collect()} == {4}


def test_drift(spark, pair):
    request = CompareRequest(("id",))
    before = drift.snapshot(compare.classify(*pair, request), "t", ["id"])
    later = spark.createDataFrame([(1, "Retail"), (2, "Moved"), (5, "New")], CATEGORY)
    now = drift.snapshot(compare.classify(pair[0], later, request), "t", ["id"])
    assert {(r.row_key, r.kind) for r in drift.drift(before, now).collect()} == {("2", "moved"), ("4", "settled"), ("5", "appeared")}
    assert drift.drift(before, before).collect() == []


def test_a_profile_is_one_scan_without_repeating_rows(spark, tmp_path):
    import decimal

    rows = [(i, i % 3, None if i % 4 == 0 else f"v{i % 5}", i / 2, decimal.Decimal(i % 2), *[i % (k + 2) for k in range(20)]) for i in range(40)]
    spark.createDataFrame(rows, "a int, b long, c string, d double, e decimal(5,1), " + ", ".join(f"x{k} int" for k in range(20))).write.parquet(f"{tmp_path}/wide")
    df = spark.read.parquet(f"{tmp_path}/wide").withColumn("f", F.array("a"))
    found = keys.profile(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan and plan.count("Generate") == 1
    rows_ = {r.column_name: (r.row_count, r.distinct_count, r.null_count, r.could_be_key) for r in found.collect()}
    want = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns if c != "f"]).first().asDict()
    assert {c: r[1] for c, r in rows_.items()} == want and rows_["c"][2] == 10 and rows_["a"] == (40, 40, 0, True) and len(rows_) == 25
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "z double")
    assert tuple(keys.profile(zeros).first())[1:4] == (4, 2, 0)


def test_details_read_only_where_wanted_keys_are(spark, tmp_path):
    spark.range(0, 100_000, 1, 10).selectExpr("id", "id % 7 as v").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")

    few = spark.createDataFrame([(5,), (6,), (95_000,)], "id long")
    ranges = compare.key_ranges(few, "id")
    for path in glob.glob(f"{tmp_path}/t/.*.crc"):
        os.remove(path)
    for path in glob.glob(f"{tmp_path}/t/part-*"):  # in every file that holds no wanted key the data is spoilt, its statistics aren't
        keys_ = {r.id // 10_000 for r in spark.read.parquet(path).select("id").limit(1).collect()}
        if keys_ & {0, 9}:
            continue
        with open(path, "r+b") as f:
            data = f.read()
            footer = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
            f.seek(4)
            f.write(b"X" * (footer - 4))
    with pytest.raises(Exception):
        table.agg(F.sum("id")).collect()
    assert sorted(r.id for r in compare.fetch(table, few, ["id"], ranges).collect()) == [5, 6, 95_000]
    changed = table.withColumn("v", F.when(F.col("id").isin(7, 95_001), 99).otherwise(F.col("v")))
    wanted = spark.createDataFrame([(7,), (95_001,)], "id long")
    assert compare.fetch(changed, wanted, ["id"], compare.key_ranges(wanted, "id")).where("v = 99").count() == 2
    assert compare.key_ranges(few, "id", 3)[0][0] == 5 and compare.key_ranges(few.limit(0), "id") == []
