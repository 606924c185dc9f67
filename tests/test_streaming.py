"""Streams against the batch result over the same rows."""

import pytest
from pyspark.sql import functions as F

from thriftline.operators import corrections as batch
from thriftline.sources import derived as d
from thriftline.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    d.commands(spark, SF).repartition(4).write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path).schema


def drained(stream, name, mode="append", checkpoint=None):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (q.option("checkpointLocation", checkpoint) if checkpoint else q).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_ingest_and_retention(spark, feed, tmp_path):
    path, schema = feed
    out = str(tmp_path / "facts")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(jobs.command_stream(spark, path, schema).drop("saved_tokens", "savings_pct"), out, str(tmp_path / "cp")).awaitTermination(240)
    got = spark.read.parquet(out)
    assert got.count() == d.commands(spark, SF).count()
    assert got.agg(F.sum("saved_tokens")).first() == d.commands(spark, SF).agg(F.sum("saved_tokens")).first()
    gone = jobs.expired_days(spark, out, "2024-05-01")
    assert gone and max(gone) < "2024-02-01" and jobs.expired_days(spark, out, "2024-01-02") == []


def test_retention_survives_a_restart_before_the_commit(spark, feed, tmp_path, monkeypatch):
    """The first run fails after days were dropped; the second takes the same batch again."""
    path, schema = feed
    out, as_of = str(tmp_path / "facts"), "2024-03-01"
    stream = jobs.command_stream(spark, path, schema).drop("saved_tokens", "savings_pct")
    real, calls = jobs.expired_days, []

    def fails(*a):
        yield from real(*a)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "expired_days", fails)
    with pytest.raises(Exception, match="lost"):
        jobs.maintained(stream, out, str(tmp_path / "cp"), as_of, 30).awaitTermination(240)
    left = sorted(p.name for p in (tmp_path / "facts").iterdir() if p.name.startswith("day="))
    assert left and min(left) >= "day=2024-01-31"  # dropped, and not committed
    for _ in range(2):
        jobs.maintained(stream, out, str(tmp_path / "cp"), as_of, 30).awaitTermination(240)
    kept = d.commands(spark, SF).filter(F.to_date("ts") >= F.lit("2024-01-31").cast("date"))
    got = spark.read.parquet(out)
    assert got.count() == kept.count() == got.select("id").distinct().count() and got.agg(F.min("day")).first()[0].isoformat() >= "2024-01-31"


def test_daily_rollup(spark, feed):
    path, schema = feed
    got = {r.start.date(): (r.commands, r.saved_tokens) for r in drained(jobs.rollup(jobs.with_savings(jobs.command_stream(spark, path, schema))), "daily").collect()}
    want = {r.day: (r.n, r.s) for r in d.commands(spark, SF).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("saved_tokens").alias("s")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 3  # the last days wait for the watermark


def test_trailing_rollup(spark, feed):
    path, schema = feed
    got = drained(jobs.rollup(jobs.with_savings(jobs.command_stream(spark, path, schema)), "7 days", "1 day"), "trailing").collect()
    assert got and all((r.end - r.start).days == 7 for r in got)


def test_repeats_go(spark, feed, tmp_path):
    path, schema = feed
    stream = jobs.with_savings(jobs.command_stream(spark, path, schema))
    got = drained(jobs.without_repeats(stream.unionByName(stream)), "once")
    assert got.count() == got.select("id").distinct().count() == d.commands(spark, SF).count()


def test_lines(spark):
    rows = spark.createDataFrame([("test a ... ok",), ("test b ... FAILED",), ("test result: ok",), ("",), ("test c",), ("  note",)], "line string")
    assert [r[0] for r in jobs.matching_lines(rows).collect()] == ["test b ... FAILED", "test result: ok", "", "  note"]


def test_corrections_as_they_come(spark, tmp_path):
    calls = d.tool_calls(spark, SF)
    path = str(tmp_path / "calls")
    calls.coalesce(1).sortWithinPartitions("session_id", "sequence_index").write.parquet(path)
    stream = spark.readStream.schema(calls.schema).parquet(path)
    cols = ["session_id", "sequence_index", "wrong_command", "right_command", "error_class", "confidence"]
    got = sorted(tuple(r) for r in drained(jobs.corrections(stream), "fixes").select(*cols).collect())
    assert got and got == sorted(tuple(r) for r in batch.corrections(calls).select(*cols).collect())
