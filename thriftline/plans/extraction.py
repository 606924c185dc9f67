"""Queries of extraction: outputs are written as each tool would, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.operators import extraction as x
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d

DIAG = "output_id, '{tool}' AS tool, file, line, col, {severity} AS severity, {code} AS code, message"
SEVERITY = "CASE WHEN bad THEN 'error' ELSE 'warning' END"
lit, col = F.lit, F.col


def sql_of(tool: str, severity: str = SEVERITY, code: str = "code", where: str = "") -> str:
    return f"SELECT {DIAG.format(tool=tool, severity=severity, code=code)} FROM tool_rows_v {where}"


def eslint_outputs(spark: SparkSession, sf: str) -> DataFrame:
    message = F.struct("line", col("col").alias("column"), F.when(col("bad"), 2).otherwise(1).alias("severity"), "message", F.when(col("n") % 11 != 0, col("code")).alias("ruleId"))
    return d.tool_json(spark, sf, F.struct(col("file").alias("filePath"), F.array(message).alias("messages")))


def mypy_outputs(spark: SparkSession, sf: str, numbered: bool = True) -> DataFrame:
    error = F.concat("file", lit(":"), "line", lit(":"), "col", lit(": error: "), "message", lit("  [r-"), col("n") % 9, lit("]"))
    return d.tool_text(spark, sf, F.when(col("n") % 4 == 1, F.concat("file", lit(":"), "line", lit(": note: see "), col("n"))).when(col("n") % 4 == 2, lit("Found 3 errors")).otherwise(error), numbered)


view("eslint_v", sql_of("eslint", code="CASE WHEN n % 11 <> 0 THEN code ELSE 'unknown' END"))


@query("SELECT * FROM eslint_v")
def ext_eslint(spark: SparkSession, sf: str) -> DataFrame:
    return x.eslint(eslint_outputs(spark, sf))


@query(sql_of("ruff", "'error'"))
def ext_ruff(spark: SparkSession, sf: str) -> DataFrame:
    return x.ruff(d.tool_json(spark, sf, F.struct("code", "message", F.struct(col("line").alias("row"), col("col").alias("column")).alias("location"), col("file").alias("filename"))))


@query(sql_of("pylint", code="code || ' (C' || n % 5 || ')'"))
def ext_pylint(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(col("bad"), F.when(col("n") % 2 == 0, "error").otherwise("fatal")).otherwise("convention")
    return x.pylint(d.tool_json(spark, sf, F.struct(kind.alias("type"), col("file").alias("path"), "line", col("col").alias("column"), col("code").alias("symbol"), F.concat(lit("C"), col("n") % 5).alias("message-id"), "message")))


def golangci_outputs(spark: SparkSession, sf: str) -> DataFrame:
    issue = F.struct(col("code").alias("FromLinter"), col("message").alias("Text"), F.struct(col("file").alias("Filename"), col("line").alias("Line"), col("col").alias("Column")).alias("Pos"))
    return d.tool_json(spark, sf, issue, "Issues")


@query(sql_of("golangci", "'error'"))
def ext_golangci(spark: SparkSession, sf: str) -> DataFrame:
    return x.golangci(golangci_outputs(spark, sf))


@query(sql_of("mypy", "'error'", "'r-' || n % 9", "WHERE n % 4 NOT IN (1, 2)"))
def ext_mypy(spark: SparkSession, sf: str) -> DataFrame:
    return x.mypy(mypy_outputs(spark, sf, numbered=False))


@query("""SELECT output_id, arg_min(file, n) AS file, arg_min(line, n) AS line, arg_min(message, n) AS message, count(*) FILTER (note AND file = head) AS notes FROM (
SELECT *, first_value(file) OVER (PARTITION BY output_id, block ORDER BY n) AS head FROM (
SELECT *, n % 4 = 1 AS note, sum((n % 4 <> 1)::INT) OVER (PARTITION BY output_id ORDER BY n) AS block FROM tool_rows_v WHERE n % 4 <> 2) WHERE block > 0) GROUP BY output_id, block""")
def win_attach_notes(spark: SparkSession, sf: str) -> DataFrame:
    return x.mypy_notes(mypy_outputs(spark, sf))


@query(sql_of("tsc", code="'TS' || 1000 + n % 9"))
def ext_tsc(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat("file", lit("("), "line", lit(","), "col", lit("): "), F.when(col("bad"), "error").otherwise("warning"), lit(" TS"), (col("n") % 9 + 1000).cast("string"), lit(": "), "message")
    return x.tsc(d.tool_text(spark, sf, line, numbered=False))


@query("SELECT output_id, 'go' AS tool, 'a/f' || n % 7 || '.go' AS file, line, CASE WHEN bad THEN col END AS col, 'error' AS severity, NULL::VARCHAR AS code, message FROM tool_rows_v WHERE n % 5 <> 0")
def ext_go_build(spark: SparkSession, sf: str) -> DataFrame:
    at = F.concat(lit("a/f"), col("n") % 7, lit(".go:"), "line", lit(":"), F.when(col("bad"), F.concat("col", lit(":"))).otherwise(""), lit(" "), "message")
    return x.go_build(d.tool_text(spark, sf, F.when(col("n") % 5 == 0, lit("# package")).otherwise(at), numbered=False))


@query("SELECT output_id, tool, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings, count(DISTINCT file) AS files FROM eslint_v GROUP BY 1, 2")
def agg_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return x.diagnostic_totals(x.eslint(eslint_outputs(spark, sf)))


@query("SELECT tool, code, count(*) AS n FROM eslint_v GROUP BY 1, 2")
def agg_diag_by_code(spark: SparkSession, sf: str) -> DataFrame:
    return x.by_code(x.eslint(eslint_outputs(spark, sf)))


@query("SELECT output_id, file, max(c)::BIGINT AS n, list(message ORDER BY r) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY output_id, file ORDER BY line, col, message) AS r, count(*) OVER (PARTITION BY output_id, file) AS c FROM eslint_v) WHERE r <= 3 GROUP BY 1, 2")
def agg_diag_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return x.by_file(x.eslint(eslint_outputs(spark, sf)))


@query("SELECT output_id, 'p' || n % 3 AS package, count(*) FILTER (n % 4 = 0) AS passed, count(*) FILTER (n % 4 = 1) AS failed, count(*) FILTER (n % 4 = 2) AS skipped FROM tool_rows_v WHERE n % 5 <> 0 GROUP BY 1, 2")
def ext_go_test(spark: SparkSession, sf: str) -> DataFrame:
    """ext_go_test and src_ndjson_events."""
    action = F.element_at(F.array(lit("pass"), lit("fail"), lit("skip"), lit("run")), (col("n") % 4 + 1).cast("int"))
    event = F.to_json(F.struct(action.alias("Action"), F.concat(lit("p"), col("n") % 3).alias("Package"), F.concat(lit("T"), col("n")).alias("Test")))
    return x.go_tests(d.tool_text(spark, sf, F.when(col("n") % 5 == 0, lit("ok, no JSON")).otherwise(event), numbered=False))


def package_outputs(spark: SparkSession, sf: str) -> DataFrame:
    version = F.concat(lit("1."), col("n") % 5)
    return d.tool_json(spark, sf, F.struct(F.concat(lit("pkg"), col("n") % 97).alias("name"), version.alias("version"), F.when(col("bad"), lit("2.0")).otherwise(version).alias("latest_version")))


@query("SELECT output_id, 'pkg' || n % 97 AS name, '1.' || n % 5 AS current_version, CASE WHEN bad THEN '2.0' ELSE '1.' || n % 5 END AS latest_version FROM tool_rows_v")
def ext_pip_list(spark: SparkSession, sf: str) -> DataFrame:
    return x.pip_packages(package_outputs(spark, sf))


@query("SELECT output_id, count(*) AS packages, count(*) FILTER (bad) AS outdated FROM tool_rows_v GROUP BY 1")
def agg_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return x.dependency_totals(x.pip_packages(package_outputs(spark, sf)))


@query("SELECT 'P' AS letter, list(name ORDER BY name) AS names FROM (SELECT DISTINCT 'pkg' || n % 97 AS name FROM tool_rows_v ORDER BY name LIMIT 10)")
def agg_packages_by_letter(spark: SparkSession, sf: str) -> DataFrame:
    return x.packages_by_letter(x.pip_packages(package_outputs(spark, sf)))


@query("""SELECT output_id, file, count(*) FILTER (n % 6 IN (1, 2)) AS added, count(*) FILTER (n % 6 = 3) AS removed FROM (
SELECT *, last_value(CASE WHEN n % 6 = 0 THEN 'f' || n % 5 END IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY n) AS file FROM (SELECT output_id, n FROM tool_rows_v)) WHERE file IS NOT NULL GROUP BY 1, 2""")
def agg_diff_stat(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(col("n") % 6 == 0, F.concat(lit("+++ b/f"), col("n") % 5)).when(col("n") % 6 < 3, F.concat(lit("+"), "message")).when(col("n") % 6 == 3, F.concat(lit("-"), "message")).when(col("n") % 6 == 4, "--- a/x").otherwise(F.concat(lit(" "), "message"))
    return x.diff_stat(d.tool_text(spark, sf, line))
