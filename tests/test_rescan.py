"""Scans that read only what has changed."""

import glob
import json
import os

import pytest

from plumbline.operators import rescan, screen
from plumbline.session import CompareSession
from plumbline.sources.catalog import ParquetDatabase


def write(spark, path, rows, files=1, mode="append"):
    spark.createDataFrame(rows, "id int, s string").repartition(files).write.mode(mode).parquet(path)


def spoil(path):
    """Another content of the same size and time: whoever reads the file fails."""
    at = os.stat(path)
    with open(path, "r+b") as f:
        f.write(b"X" * at.st_size)
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))


def data_files(folder):
    return sorted(glob.glob(f"{folder}/**/part-*", recursive=True))


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    folder, store = f"{tmp_path}/a b", rescan.FingerprintStore(spark, f"{tmp_path}/kept")
    write(spark, folder, [(i, f"r{i}") for i in range(40)], 4)
    watch = lambda: rescan.watch_folder(spark, "t", folder)
    whole = lambda: screen.fingerprint(spark.read.parquet(folder), ["id", "s"], "t").first()
    assert store.scan([watch()]).first() == whole() and store.files_read == {"t": 4}
    assert store.scan([watch()]).first() == whole() and store.files_read == {"t": 0}
    before = data_files(folder)
    write(spark, folder, [(100, "new"), (101, None)])
    expected = whole()
    for path in before:
        spoil(path)
    assert store.scan([watch()]).first() == expected and store.files_read == {"t": 1}
    gone = before[0]
    os.remove(gone)
    assert store.scan([watch()]).first().row_count == expected.row_count - 10 and store.files_read == {"t": 0}
    assert store.scan([rescan.watch_folder(spark, "t", folder, profile="portable")]).collect() == [] and "t" in store.failed  # another rule knows nothing
    assert store.scan([]).collect() == []


def test_partitioned_and_empty_tables(spark, tmp_path):
    folder, store = f"{tmp_path}/p", rescan.FingerprintStore(spark, f"{tmp_path}/kept")
    spark.createDataFrame([(i, f"v {i % 3}", i) for i in range(9)], "id int, part string, n int").write.partitionBy("part").parquet(folder)
    write(spark, f"{tmp_path}/none", [])
    tables = lambda: [rescan.watch_folder(spark, "p", folder, ["id", "part"]), rescan.watch_folder(spark, "none", f"{tmp_path}/none")]
    for _ in range(2):
        found = {r.table_name: tuple(r)[1:] for r in store.scan(tables()).collect()}
        assert found["none"] == (0, 0, "0") and found["p"] == tuple(screen.fingerprint(spark.read.parquet(folder), ["id", "part"]).first())[1:]
    assert store.files_read == {"p": 0, "none": 0}


@pytest.mark.parametrize("bad", [set(), {3}, {0, 6}, set(range(7))])
def test_bad_names_are_halved_out(bad):
    runs = []

    def run(names):
        runs.append(names)
        if any(int(n) in bad for n in names):
            raise OSError
        return names

    parts, failed = screen.spared([str(i) for i in range(7)], run)
    assert {n for p in parts for n in p} == {str(i) for i in range(7) if i not in bad} and set(failed) == {str(i) for i in bad}
    assert len(runs) <= 1 + 6 * max(1, len(bad))


def test_a_session_scans_by_kept_fingerprints(spark, tmp_path):
    for side, rows in (("source", [(1, "a"), (2, "b")]), ("target", [(1, "a"), (2, "c")])):
        write(spark, f"{tmp_path}/{side}/x.parquet", rows)
        write(spark, f"{tmp_path}/{side}/y.parquet", [(1, "same")])
        write(spark, f"{tmp_path}/{side}/z.parquet", [(1, "broken")])
        (tmp_path / side / "constraints.json").write_text(json.dumps({n: {"primary_key": ["id"]} for n in "xyz"}))
    store = rescan.FingerprintStore(spark, f"{tmp_path}/kept")
    session = CompareSession(*[ParquetDatabase(spark, f"{tmp_path}/{s}") for s in ("source", "target")], kept=store)
    states = lambda: {r.table_name: r.state for r in session.scan(again=True).collect()}
    assert states() == {"x": "differs", "y": "same", "z": "same"}
    for path in data_files(f"{tmp_path}/target/x.parquet"):
        os.remove(path)
    write(spark, f"{tmp_path}/target/x.parquet", [(1, "a"), (2, "b")])
    [broken] = data_files(f"{tmp_path}/target/z.parquet")
    os.utime(broken, (1, 1))
    spoil(broken)
    [known] = data_files(f"{tmp_path}/source/y.parquet")
    spoil(known)  # known as it was, so not read
    with pytest.raises(Exception):
        spark.read.schema("id int, s string").parquet(known).collect()
    assert {k: v for k, v in states().items() if k != "y"} == {"x": "same", "z": "not comparable"}
