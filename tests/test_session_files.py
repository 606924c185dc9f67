"""Log files read in several splits, and pruned by time and folder."""

import os
import random

import pytest

from thriftline.sources import sessions


@pytest.fixture()
def logs(tmp_path):
    rng, want = random.Random(1), {}
    for project in ("-w-p1", "-w-p2", "-w-p10"):
        (tmp_path / project).mkdir()
        for i in range(2):
            path = tmp_path / project / f"s{i}.jsonl"
            lines = ["é" * rng.randrange(80) + str(j) for j in range(rng.choice([1, 400, 3000]))]
            path.write_bytes(("\r\n" if i else "\n").join(lines).encode() + b"\n")
            want[f"{project}/s{i}.jsonl"] = lines
    (tmp_path / "-w-p1" / "notes.txt").write_text("no log\n")
    return tmp_path, want


@pytest.mark.parametrize("split", ["4096", "134217728"])
def test_lines_are_numbered_across_splits(spark, logs, split):
    path, want = logs
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sessions.read_session_lines(spark, str(path))
        got = {}
        for r in rows.collect():
            got.setdefault("/".join(r.session_id.split("/")[-2:]), {})[r.line_no] = r.value
        if split == "4096":
            assert spark.read.option("recursiveFileLookup", "true").text(str(path)).rdd.getNumPartitions() > len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def test_files_are_pruned(spark, logs):
    path, want = logs
    rows = sessions.read_session_lines(spark, str(path), project="-w-p1")
    assert {r.session_id.split("/")[-2] for r in rows.select("session_id").distinct().collect()} == {"-w-p1", "-w-p10"}
    for name in want:
        if "s0" in name:
            os.utime(path / name, (1_000_000_000, 1_000_000_000))
    rows = sessions.read_session_lines(spark, str(path), modified_after="2010-01-01T00:00:00")
    assert {r.session_id.rsplit("/", 1)[1] for r in rows.select("session_id").distinct().collect()} == {"s1.jsonl"}
    assert sessions.encoded_project("/w/p1") == "-w-p1"
