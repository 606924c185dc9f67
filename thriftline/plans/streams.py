"""Streaming queries: run over what there is, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.plans.registry import query
from thriftline.plans.telemetry import ntz
from thriftline.session import shared_path
from thriftline.sources import derived as d
from thriftline.streaming import jobs


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """The command feed, from the events table as a stream."""
    schema = d.read(spark, sf, "events").schema
    return jobs.with_savings(d.commands_of(jobs.table_stream(spark, sf, "events", schema)))


CLOSED = "(SELECT max(ts) - INTERVAL 2 DAY AS seen FROM commands_v)"
SUMS = "count(*) AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, CASE WHEN sum(input_tokens) > 0 THEN sum(saved_tokens) * 100.0::DOUBLE / sum(input_tokens) ELSE 0 END AS savings_pct"


@query("SELECT id, saved_tokens, savings_pct, CAST(ts AS DATE) AS day FROM commands_v")
def str_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.drained(commands(spark, sf).select("id", "saved_tokens", "savings_pct", "day"), "ingest")


@query(f'SELECT start, start + INTERVAL 1 DAY AS "end", c.* EXCLUDE (start) FROM (SELECT date_trunc(\'day\', ts)::TIMESTAMP AS start, {SUMS} FROM commands_v GROUP BY 1) c, {CLOSED} WHERE start + INTERVAL 1 DAY <= seen')
def str_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(jobs.drained(jobs.rollup(commands(spark, sf)), "daily"), "start", "end")


@query(f"""SELECT start, start + INTERVAL 7 DAY AS "end", c.* EXCLUDE (start) FROM (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(i::INT) AS start, {SUMS} FROM commands_v, range(7) r(i) GROUP BY 1) c, {CLOSED} WHERE start + INTERVAL 7 DAY <= seen""")
def str_trailing_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(jobs.drained(jobs.rollup(commands(spark, sf), "7 days", "1 day"), "trailing"), "start", "end")


@query("SELECT id, filtered_cmd FROM commands_v")
def str_dedup(spark: SparkSession, sf: str) -> DataFrame:
    twice = commands(spark, sf).unionByName(commands(spark, sf))
    return jobs.drained(jobs.without_repeats(twice).select("id", "filtered_cmd"), "dedup")


@query("SELECT day, count(*) AS commands FROM (SELECT CAST(ts AS DATE) AS day FROM commands_v) WHERE day >= DATE '2024-04-01' - 60 GROUP BY 1")
def str_retention(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of an ingested table whose days past retention were dropped as it was ingested."""
    at = shared_path(spark, "retained")
    schema = d.read(spark, sf, "events").schema
    feed = d.commands_of(jobs.table_stream(spark, sf, "events", schema)).select("id", "ts", "input_tokens", "output_tokens")
    jobs.maintained(feed, f"{at}/rows", f"{at}/offsets", "2024-04-01", 60).awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy("day").agg(F.count("*").alias("commands"))


@query("SELECT output_id, line_no, line FROM output_lines_v WHERE NOT (starts_with(line, 'test ') AND ends_with(line, '... ok')) AND (contains(line, 'FAILED') OR contains(line, 'error') OR starts_with(line, 'test result') OR trim(line) = '' OR NOT starts_with(line, 'test '))")
def str_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    schema = d.read(spark, sf, "documents").schema
    docs = jobs.table_stream(spark, sf, "documents", schema)
    return jobs.drained(jobs.matching_lines(d.lines_of(d.outputs_of(docs)).select("output_id", "line_no", "line")), "lines")


@query("SELECT session_id, sequence_index, wrong_command, right_command, error_class, confidence FROM corrections_v")
def str_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The calls are numbered by a batch job first, as a feed of sessions would be."""
    calls = d.tool_calls(spark, sf)
    at = jobs.table_in_shared(calls, "calls")
    return jobs.drained(jobs.corrections(spark.readStream.schema(calls.schema).parquet(at)), "fixes")
