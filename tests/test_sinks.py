"""Exports are written, read back and rotated."""

import datetime

import pytest
from pyspark.sql import functions as F

from thriftline.plans.sinks import PERIODS
from thriftline.session import shared_path
from thriftline.sinks import export, retained
from thriftline.sinks.store import Store
from thriftline.sources import derived

SF = "/root/testdata/sf0.001"


def store(spark, keep=1):
    return Store(spark, shared_path(spark, "test"), keep)


def files(spark, root):
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return sorted(f.getPath().getName() for f in fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs_path))


def test_versions_rotate_and_name_their_files(spark):
    to = store(spark, keep=2)
    with pytest.raises(FileNotFoundError):
        to.at("t")
    for i in range(4):
        assert to.commit({"t": (spark.range(i + 1), "parquet", {})}) == i + 1
    assert to.versions() == [3, 4] and spark.read.parquet(to.at("t")).count() == 4 and spark.read.parquet(to.at("t", 3)).count() == 3
    said = to.manifest()
    assert said["version"] == 4 and all(n.startswith("t/") and size >= 0 for n, size in said["files"].items()) and any(n.endswith(".parquet") for n in said["files"])


def test_what_a_writer_left_behind_is_not_read(spark):
    to = store(spark)
    to.commit({"t": (spark.range(3), "parquet", {})})
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        to.commit({"t": (spark.range(5), "parquet", {}), "u": (broken, "parquet", {})})
    assert spark.read.parquet(to.at("t")).count() == 3 and any(f.startswith("_staging") for f in files(spark, to.root))
    to.commit({"t": (spark.range(5), "parquet", {})})
    assert files(spark, to.root) == ["v00000002"] and spark.read.parquet(to.at("t")).count() == 5


def test_delimited_files_have_headers_and_all_columns(spark):
    to = store(spark)
    export.write_csv(derived.commands(spark, SF), to)
    for g in PERIODS:
        lines = [r.value for r in spark.read.text(to.at(g)).collect()]
        assert [x for x in lines if x.startswith("date,")][0].split(",") == [*export.PERIOD[:1], *(["week_end"] if g == "weekly" else []), *export.PERIOD[1:]]
        assert export.read_csv(spark, to, g).count() == len([x for x in lines if not x.startswith("date,")])


def test_documents_hold_what_was_asked_for(spark):
    c = derived.commands(spark, SF)
    bare = export.document_rows(export.gain_document(c)).collect()
    assert {r.section for r in bare} == {"summary", "by_command"}
    whole = export.document_rows(export.gain_document(c, daily=True, weekly=True, monthly=True, history=True, limit=2)).collect()
    assert {r.section for r in whole} == {"summary", "by_command", "history", *PERIODS} and sum(r.section == "by_command" for r in whole) == 2
    none = export.document_rows(export.gain_document(c.limit(0), daily=True)).collect()
    assert [(r.section, r.commands) for r in none] == [("summary", 0)]


def outputs(spark, rows):
    return spark.createDataFrame(rows, "output_id long, command string, exit_code int, captured_at long, text string")


def test_the_newest_files_stay(spark):
    to = store(spark)
    first = [(i, f"run a/b {i % 3}", 1, 1000 + i, "x" * 600) for i in range(10)]
    retained.retain(outputs(spark, first), to, most_files=4)
    assert [r.output_id for r in retained.kept(to).orderBy("file_name").collect()] == [6, 7, 8, 9]
    second = [(20, "run", 1, 1008, "y" * 600), (21, "run", 0, 5000, "y" * 600), (22, "run", 2, 6000, "short"), (23, None, 1, 7000, None), (24, "ü" * 50, 1, 2000, "é" * 400)]
    retained.retain(outputs(spark, second), to, most_bytes=701, most_files=4)
    got = {r.file_name: (r.output_id, r.content) for r in retained.kept(to).collect()}
    assert got == {"0000001008_run_a_b_2.log": (8, "x" * 600), "0000001008_run.log": (20, "y" * 600), "0000001009_run_a_b_0.log": (9, "x" * 600), f"0000002000_{'_' * 40}.log": (24, "é" * 350 + "\n\n--- truncated at 701 bytes ---")}
    retained.retain(outputs(spark, second), to, most_bytes=701, most_files=4)  # again: nothing changes
    assert {r.file_name: (r.output_id, r.content) for r in retained.kept(to).collect()} == got


def test_modes_of_retention(spark):
    rows = outputs(spark, [(1, "a", 0, 1, "x" * 500), (2, "a", 1, 2, "x" * 500), (3, "a", 1, 3, "x" * 499)])
    assert {m: sorted(r.output_id for r in retained.wanted(rows, m).collect()) for m in ("never", "failures", "always")} == {"never": [], "failures": [2], "always": [1, 2]}
    with pytest.raises(ValueError, match="none of"):
        retained.wanted(rows, "sometimes")


def test_economics_leave_empty_what_a_side_lacks(spark):
    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([(day, None, None, None, None, None, None, 5, 7, None, None, None)], "day date, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long, total_cost double, commands long, saved_tokens long, weighted_savings double, active_savings double, blended_savings double")
    to = store(spark)
    export.write_economics({"daily": (rows, "day")}, to, rows.limit(0).drop("day"))
    got = export.read_economics(spark, to, "daily").collect()[0]
    assert (got.period, got.spent, got.saved_tokens, got.tracked_commands) == ("2024-01-01", "", "7", "5")
