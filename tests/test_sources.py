"""Reading CSV by header name, and sessions without the usual surroundings."""

import os
import subprocess
import sys

import pytest

from wardwise.sources.io import read_csv, read_csv_checked, write_csv

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def put(folder, *files):
    folder.mkdir()
    for k, text in enumerate(files):
        (folder / f"part-{k}.csv").write_text(text)
    return str(folder)


def test_columns_are_read_by_name(spark, tmp_path):
    path = put(tmp_path / "t", "b,extra,a\n2,x,1\n4,y,3\n")
    assert sorted(tuple(r) for r in read_csv(spark, path, "a int, b int").collect()) == [(1, 2), (3, 4)]


def test_missing_column_and_file(spark, tmp_path):
    path = put(tmp_path / "t", "a,c\n1,2\n")
    with pytest.raises(ValueError, match="no column b"):
        read_csv(spark, path, "a int, b int")
    assert read_csv(spark, str(tmp_path / "none"), "a int") is None


def test_malformed_records_are_set_aside(spark, tmp_path):
    path = put(tmp_path / "t", 'day,n,x,name\n2024-01-02,1,1.5,"a, b"\n2024-13-02,1,2,c\n2024-01-03,one,z,d\n2024-01-04,2\n2024-01-05,3,,\n')
    rows, rejected = read_csv_checked(spark, path, "name string, n bigint, x double, day date")
    assert sorted((r.name or "", r.n, r.x, str(r.day)) for r in rows.collect()) == [("", 3, None, "2024-01-05"), ("a, b", 1, 1.5, "2024-01-02")]
    got = {r.record: r.reasons for r in rejected.collect()}
    assert got == {"2024-13-02,1,2,c": ["day: not date"], "2024-01-03,one,z,d": ["n: not bigint", "x: not double"], "2024-01-04,2": ["number of fields"]}


def test_required_columns(spark, tmp_path):
    path = put(tmp_path / "t", "a,b\n1,\n,2\n")
    rows, rejected = read_csv_checked(spark, path, "a int NOT NULL, b int")
    assert [tuple(r) for r in rows.collect()] == [(1, None)] and [r.reasons for r in rejected.collect()] == [["a: empty"]]


def test_files_with_another_header_are_no_silent_mix(spark, tmp_path):
    path = put(tmp_path / "t", "a,b\n1,2\n", "b,a\n1,2\n")
    with pytest.raises(Exception, match="[Hh]eader"):
        read_csv(spark, path, "a int, b int").collect()


def test_overwriting_keeps_the_old_table_if_writing_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (2, 3):
        write_csv(spark.range(n).selectExpr("id AS a"), path)
    with pytest.raises(Exception, match="broken"):
        write_csv(spark.range(9).selectExpr("if(id < 5, 1, raise_error('broken')) AS b", "id AS a"), path)
    assert sorted(r.a for r in read_csv(spark, path, "a int").collect()) == [0, 1, 2]


def child(code, tmp_path, **env):
    surroundings = os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)} | env
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=surroundings, timeout=300, cwd=tmp_path)


def test_session_without_a_configured_checkpoint_folder(tmp_path):
    """A local session makes its own folder; checkpoints and written tables land in it."""
    done = child("from wardwise.session import get_spark, checkpoint_dir\n"
                 "from wardwise.sources.io import materialize\n"
                 "s = get_spark('local[2]')\n"
                 "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
                 "a, b = checkpoint_dir(s), checkpoint_dir(s)\n"
                 "assert a and a == b == s.sparkContext.getCheckpointDir()\n"
                 "print('rows', materialize(s.range(5)).count())\n", tmp_path)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
