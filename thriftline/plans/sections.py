"""Queries of tool outputs with sections and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.operators import economics
from thriftline.operators import extraction as x
from thriftline.operators import sections as op
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d

lit, col = F.lit, F.col


def text_of(spark: SparkSession, sf: str, line) -> DataFrame:
    return x.lines_of(d.tool_text(spark, sf, line))


def cargo_lines(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.when(col("bad"), "error[E0").otherwise("warning[W0"), col("n") % 9, lit("]: "), lit("unused "), col("n") % 13)
    block = F.concat(head, lit("\n  --> "), "file", lit(":"), "line", lit(":"), "col", lit("\n   | x\n   = note: y"))
    return text_of(spark, sf, F.when(col("n") % 8 == 0, "   Compiling x v1.0").when(col("n") % 8 == 1, "warning: 3 warnings emitted").otherwise(block))


view("cargo_v", "SELECT output_id, 'cargo' AS tool, file, line, col, CASE WHEN bad THEN 'error' ELSE 'warning' END AS severity, CASE WHEN bad THEN 'E0' ELSE 'W0' END || n % 9 AS code, 'unused ' || n % 13 AS message FROM tool_rows_v WHERE n % 8 NOT IN (0, 1)")


@query("SELECT * FROM cargo_v")
def ext_cargo_build(spark: SparkSession, sf: str) -> DataFrame:
    """ext_cargo_build, ext_clippy and win_block_header."""
    return op.rust_blocks(cargo_lines(spark, sf), "cargo")


@query("""SELECT output_id, message, c AS n, list(file || ':' || line ORDER BY file, line, col) FILTER (r <= 3) AS places, any_value(k)::INT AS rank FROM (
SELECT *, dense_rank() OVER (PARTITION BY output_id ORDER BY c DESC, message) AS k FROM (
SELECT *, count(*) OVER (PARTITION BY output_id, message) AS c, row_number() OVER (PARTITION BY output_id, message ORDER BY file, line, col) AS r FROM cargo_v)) WHERE k <= 15 GROUP BY 1, 2, 3""")
def agg_lint_rules(spark: SparkSession, sf: str) -> DataFrame:
    return op.lint_rules(op.rust_blocks(cargo_lines(spark, sf), "cargo"))


def pytest_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    body = F.concat(lit("FAILED a.py::t"), n, F.when(n % 2 == 0, F.concat(lit(" - Error "), n)).otherwise(""))
    tail = F.concat(lit("==== 3 failed, "), n % 50, lit(" passed, "), n % 4, lit(" skipped in 1s ===="))
    return text_of(spark, sf, F.when(n % 5 == 0, "==== FAILURES ====").when(n % 5 == 1, "==== short test summary info ====").when(n % 5 == 4, tail).otherwise(body))


@query("SELECT output_id, n % 50 AS passed, 3::BIGINT AS failed, n % 4 AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY n DESC) AS r FROM tool_rows_v WHERE n % 5 = 4) WHERE r = 1")
def ext_pytest(spark: SparkSession, sf: str) -> DataFrame:
    return op.pytest_results(pytest_lines(spark, sf))


@query("""SELECT output_id, 'a.py::t' || n AS test_name, CASE WHEN n % 2 = 0 THEN 'Error ' || n END AS error_message FROM (
SELECT *, last_value(CASE WHEN n % 5 IN (0, 1, 4) THEN n % 5 END IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY n) AS s FROM tool_rows_v) WHERE n % 5 IN (2, 3) AND s = 1""")
def win_section_state(spark: SparkSession, sf: str) -> DataFrame:
    return op.pytest_failures(pytest_lines(spark, sf))


@query("SELECT output_id, count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'FAIL') AS failed, round(sum(t), 3) AS seconds FROM (SELECT output_id, n % 40 AS k, min(CASE WHEN n % 3 = 0 THEN 'FAIL' ELSE 'PASS' END) AS s, max(n % 7 / 4.0::DOUBLE) AS t FROM tool_rows_v GROUP BY 1, 2) GROUP BY 1")
def ext_nextest(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    line = F.concat(lit("   "), F.when(n % 3 == 0, "FAIL").otherwise("PASS"), lit(" [   "), F.format_string("%.3f", (n % 7) / 4.0), lit("s] crate t"), n % 40)
    return op.nextest_results(text_of(spark, sf, line))


@query("SELECT DISTINCT output_id, ['ruff', 'black', 'prettier'][n % 4 + 1] AS tool, file FROM tool_rows_v WHERE n % 4 < 3")
def ext_ruff_format(spark: SparkSession, sf: str) -> DataFrame:
    """ext_ruff_format, ext_black and ext_prettier."""
    n = col("n")
    start = F.element_at(F.array(lit("Would reformat: "), lit("would reformat "), lit("[warn] "), lit("ok ")), (n % 4 + 1).cast("int"))
    return op.unformatted(text_of(spark, sf, F.concat(start, "file")))


@query("""SELECT output_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY line_no) AS shown FROM (
SELECT *, sum(body) OVER (PARTITION BY output_id, hunk ORDER BY line_no) AS c FROM (
SELECT *, (k NOT IN (0) AND hunk > 0 AND sum((k IN (2, 3))::INT) OVER (PARTITION BY output_id, hunk ORDER BY line_no) > 0)::INT AS body FROM (
SELECT *, sum((k = 0)::INT) OVER (PARTITION BY output_id ORDER BY line_no) AS hunk FROM (
SELECT output_id, n % 9 AS k, (row_number() OVER (PARTITION BY output_id ORDER BY n) - 1)::INT AS line_no FROM tool_rows_v)))) WHERE k = 0 OR (body = 1 AND c <= 4)) WHERE shown <= 30""")
def win_hunk_budget(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    line = F.when(n % 9 == 0, "@@ -1 +1 @@").when(n % 9 == 2, F.concat(lit("+a"), n)).when(n % 9 == 3, F.concat(lit("-b"), n)).otherwise(F.concat(lit(" c"), n))
    return op.hunks_cut(text_of(spark, sf, line), 4, 30).select("output_id", "line_no")


@query("SELECT output_id, r::INT AS row_no, ['v' || n, file] AS cells FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY n) - 1 AS r FROM tool_rows_v WHERE n % 6 <> 1) WHERE r <= 30")
def ext_psql_table(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    return op.psql_rows(text_of(spark, sf, F.when(n % 6 == 1, "----+----").otherwise(F.concat(lit(" v"), n, lit(" | "), "file", lit(" ")))))


def pod_outputs(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    phase = F.element_at(F.array(lit("Running"), lit("Running"), lit("Pending"), lit("Failed"), lit("Succeeded")), (n % 5 + 1).cast("int"))
    pod = F.struct(F.struct(F.concat(lit("pod"), n).alias("name")).alias("metadata"), F.struct(phase.alias("phase"), F.array(F.struct((n % 5).alias("restartCount")), F.struct(lit(None).cast("long").alias("restartCount"))).alias("containerStatuses")).alias("status"))
    return d.tool_json(spark, sf, pod, "items")


@query("SELECT output_id, count(*) FILTER (n % 5 < 2) AS running, count(*) FILTER (n % 5 = 2) AS pending, count(*) FILTER (n % 5 = 3) AS failed, sum(n % 5)::BIGINT AS restarts, coalesce(list_sort(list('pod' || n) FILTER (n % 5 IN (2, 3))), []) AS issues FROM tool_rows_v GROUP BY 1")
def agg_pods(spark: SparkSession, sf: str) -> DataFrame:
    return op.pod_counts(op.pods(pod_outputs(spark, sf)))


@query("SELECT output_id, 'pod' || n AS name, ['Running', 'Running', 'Pending', 'Failed', 'Succeeded'][n % 5 + 1] AS phase, n % 5 AS restarts, n % 5 IN (2, 3) AS issue FROM tool_rows_v")
def ext_pods(spark: SparkSession, sf: str) -> DataFrame:
    return op.pods(pod_outputs(spark, sf))


@query("SELECT output_id, 'run' || n AS name, CASE WHEN n % 5 = 0 THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN n % 5 <> 0 THEN CASE WHEN bad THEN 'failure' ELSE 'success' END END AS conclusion FROM tool_rows_v")
def ext_ci_runs(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    run = F.struct(F.concat(lit("run"), n).alias("name"), F.when(n % 5 == 0, "in_progress").otherwise("completed").alias("status"), F.when(n % 5 != 0, F.when(col("bad"), "failure").otherwise("success")).alias("conclusion"))
    return op.ci_runs(d.tool_json(spark, sf, run))


def usage_sql(granularity: str, key: str) -> str:
    return f"SELECT '{granularity}', {key}, {', '.join(f'sum({c})::BIGINT' for c in ('input_tokens', 'output_tokens', 'cache_creation_tokens'))}, 0::BIGINT, sum(total_tokens)::BIGINT, round(sum(total_cost), 6) FROM usage_daily_v GROUP BY 2"


@query(f"""SELECT 'daily' AS granularity, strftime(day, '%Y-%m-%d') AS key, input_tokens, output_tokens, CASE WHEN day(day) % 2 = 0 THEN cache_creation_tokens ELSE 0 END AS cache_creation_tokens, 0::BIGINT AS cache_read_tokens, total_tokens, round(total_cost, 6) AS total_cost FROM usage_daily_v
UNION ALL {usage_sql("weekly", "strftime(date_trunc('week', day), '%Y-%m-%d')")} UNION ALL {usage_sql("monthly", "strftime(day, '%Y-%m')")}""")
def src_usage_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Daily, weekly and monthly reports, a text for each month or year; some daily rows have no cache counts."""
    u = d.usage_daily(spark, sf)

    def reports(rows: DataFrame, granularity: str, field: str, key: Column, report: Column, written: Column) -> DataFrame:
        one = F.struct(key.alias(field), col("input_tokens").alias("inputTokens"), col("output_tokens").alias("outputTokens"), written.alias("cacheCreationTokens"), col("total_tokens").alias("totalTokens"), col("total_cost").alias("totalCost"))
        return rows.groupBy(report).agg(F.to_json(F.struct(F.collect_list(one).alias(granularity))).alias("text")).select("text")

    weeks = economics.usage_by(u, F.to_date(F.date_trunc("week", "day")), "week")
    months = economics.usage_by(u, F.date_format("day", "yyyy-MM"), "month")
    some, every = F.when(F.dayofmonth("day") % 2 == 0, col("cache_creation_tokens")), col("cache_creation_tokens")
    texts = reports(u, "daily", "date", F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "yyyy-MM"), some)
    texts = texts.unionByName(reports(weeks, "weekly", "week", F.date_format("week", "yyyy-MM-dd"), F.year("week"), every)).unionByName(reports(months, "monthly", "month", col("month"), F.substring("month", 1, 4), every))
    return op.usage_periods(texts).withColumn("total_cost", F.round("total_cost", 6))
