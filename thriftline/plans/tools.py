"""Queries of further tool outputs, of truncated code and of display numbers. Each input holds lines or texts that do not fit too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import json as j
from thriftline.functions import numbers as num
from thriftline.operators import extraction as x
from thriftline.operators import tools as op
from thriftline.plans.more import json_rows
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d

lit, col = F.lit, F.col


def with_broken(outputs: DataFrame) -> DataFrame:
    """Outputs of which those of every fifth id have a banner in front, so that they are no JSON, and every seventh are cut short."""
    o = col("output_id")
    return outputs.withColumn("text", F.when(o % 5 == 0, F.concat(lit("warning: old\n"), "text")).when(o % 7 == 0, F.concat(lit("["), F.substring("text", 1, 20))).otherwise(col("text")))


@query("SELECT output_id, './f' || n || '.go:' || line || ':' || col || ': unreachable' AS issue FROM tool_rows_v WHERE n % 5 > 2")
def ext_go_vet(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    place = F.concat(lit("  ./f"), n, lit(".go:"), "line", lit(":"), "col", lit(": unreachable "))
    line = F.when(n % 5 == 0, "# example.com/x.go:1").when(n % 5 == 1, "vet: no place").when(n % 5 == 2, "").otherwise(place)
    return op.vet_issues(x.lines_of(d.tool_text(spark, sf, line))).select("output_id", "issue")


@query("SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY n) AS place, n::VARCHAR AS record, 'id=' || n || ' name=a | b' || n AS pairs, row_number() OVER (PARTITION BY output_id ORDER BY n) <= 20 AS shown FROM tool_rows_v WHERE n % 7 > 1")
def ext_psql_expanded(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    block = F.concat(lit("-[ RECORD "), n, lit(" ]-+------\nid   | "), n, lit("\n\nname | a | b"), n)
    line = F.when(n % 7 == 0, "NOTICE:  nothing").when(n % 7 == 1, "(3 rows)").otherwise(block)
    return op.expanded_records(x.lines_of(d.tool_text(spark, sf, line)))


@query("SELECT output_id, n AS number, 't \"' || n || '\"' AS title, CASE WHEN bad THEN 'OPEN' ELSE 'CLOSED' END AS state, 'u' || n % 11 AS author FROM tool_rows_v WHERE output_id % 5 <> 0 AND output_id % 7 <> 0")
def ext_issues(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    item = F.struct(n.alias("number"), F.concat(lit('t "'), n, lit('"')).alias("title"), F.when(col("bad"), "OPEN").otherwise("CLOSED").alias("state"), F.struct(F.concat(lit("u"), n % 11).alias("login")).alias("author"))
    return op.issues(with_broken(d.tool_json(spark, sf, item)))


@query("SELECT output_id, 'p' || n AS name, '1.' || n % 5 AS version, CASE WHEN n % 4 = 0 THEN 'unknown' ELSE '2.' || n % 5 END AS latest FROM tool_rows_v WHERE output_id % 5 <> 0 AND output_id % 7 <> 0")
def ext_pip_outdated(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    item = F.struct(F.concat(lit("p"), n).alias("name"), F.concat(lit("1."), n % 5).alias("version"), F.when(n % 4 > 0, F.concat(lit("2."), n % 5)).alias("latest_version"))
    return op.pip_outdated(with_broken(d.tool_json(spark, sf, item)))


@query("""SELECT output_id, coalesce((array_agg('[+] Building ' || n || 's (8/8) FINISHED' ORDER BY n) FILTER (k = 2))[1], (array_agg('Building ' || n ORDER BY n) FILTER (k = 3))[1]) AS summary,
coalesce(any_value(services), []) AS services, count(*) FILTER (k = 1) AS steps FROM (SELECT *, n % 6 AS k FROM tool_rows_v) LEFT JOIN (
SELECT output_id, list(s ORDER BY f) AS services FROM (SELECT output_id, 'svc' || n % 4 AS s, min(n) AS f FROM tool_rows_v WHERE n % 6 < 2 GROUP BY 1, 2) GROUP BY 1) USING (output_id) GROUP BY 1""")
def ext_compose_build(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    step = F.concat(lit("[svc"), n % 4, lit(" 1/3] RUN [x]"))
    line = F.when(n % 6 == 0, F.concat(lit("#1 "), step)).when(n % 6 == 1, F.concat(lit(" => "), step)).when(n % 6 == 2, F.concat(lit("[+] Building "), n, lit("s (8/8) FINISHED"))).when(n % 6 == 3, F.concat(lit("Building "), n)).when(n % 6 == 4, "[ ]").otherwise("")
    return op.compose_builds(x.lines_of(d.tool_text(spark, sf, line)))


RUN_LINES = ("test result: FAILED. 1 failed", "test m::x ... FAILED", "== 3 passed, 1 failed ==", "FAIL src/a.test.js", "ok  example.com/x 0.1s", "  ", "Tests: 1 failed, 2 passed")
RUN_COMMANDS = ("cargo test", "pytest -q", "npm test", "go test ./...", "make check")


def test_runs(spark: SparkSession, sf: str) -> DataFrame:
    at = col("output_id") + col("line_no")
    said = F.element_at(F.array(*map(lit, RUN_LINES)), (at % len(RUN_LINES) + 1).cast("int"))
    command = F.element_at(F.array(*map(lit, RUN_COMMANDS)), (col("output_id") % len(RUN_COMMANDS) + 1).cast("int"))
    return d.output_lines(spark, sf).select("output_id", "line_no", command.alias("command"), F.when(at % 3 == 0, said).otherwise(F.concat(lit("log: "), "line")).alias("line"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


view("test_runs_v", f"""SELECT *, CASE c WHEN 'cargo test' THEN contains(line, 'test result:') OR regexp_matches(line, '^(ok|FAIL|---)') WHEN 'pytest -q' THEN regexp_matches(line, ' passed| failed| error') WHEN 'npm test' THEN regexp_matches(line, 'Tests:|Test Suites:')
WHEN 'go test ./...' THEN regexp_matches(line, '^(ok|FAIL|---)') ELSE false END AS r,
CASE c WHEN 'cargo test' THEN contains(line, 'FAIL') WHEN 'pytest -q' THEN contains(line, 'FAILED') WHEN 'npm test' THEN regexp_matches(line, '✕|FAIL') WHEN 'go test ./...' THEN contains(line, 'FAIL') ELSE false END AS f
FROM (SELECT output_id, line_no, {_list(RUN_COMMANDS)}[output_id % {len(RUN_COMMANDS)} + 1] AS c,
CASE WHEN (output_id + line_no) % 3 = 0 THEN {_list(RUN_LINES)}[(output_id + line_no) % {len(RUN_LINES)} + 1] ELSE 'log: ' || line END AS line FROM output_lines_v)""")


@query("""SELECT output_id, section, line_no, line, n_failures FROM (
SELECT output_id, 'failures' AS section, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY line_no) AS k FROM test_runs_v WHERE f) WHERE k <= 10
UNION ALL SELECT output_id, 'summary', line_no, line FROM test_runs_v WHERE r
UNION ALL SELECT output_id, 'output', line_no, line FROM (SELECT *, max(line_no) OVER (PARTITION BY output_id) AS m, bool_or(r) OVER (PARTITION BY output_id) AS any_r FROM test_runs_v) WHERE NOT any_r AND line_no > m - 5 AND trim(line) <> '')
JOIN (SELECT output_id, count(*) FILTER (f) AS n_failures FROM test_runs_v GROUP BY 1) USING (output_id)""")
def agg_test_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.test_summary(test_runs(spark, sf))


CODE_LINES = ("pub fn run() {", "}", "import os", "    x = 1", "  export const A = 1", "class B:", "// note")


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    at = col("output_id") * 3 + col("line_no")
    code = F.element_at(F.array(*map(lit, CODE_LINES)), (at % len(CODE_LINES) + 1).cast("int"))
    return d.output_lines(spark, sf).select("output_id", "line_no", F.when(at % 4 == 0, code).otherwise(col("line")).alias("line"))


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY line_no) AS p, count(*) OVER (PARTITION BY output_id) AS total, (output_id * 3 + line_no) % 4 = 0 AND (output_id * 3 + line_no) % {len(CODE_LINES)} NOT IN (3, 6) AS imp FROM (
SELECT output_id, line_no, CASE WHEN (output_id * 3 + line_no) % 4 = 0 THEN {_list(CODE_LINES)}[(output_id * 3 + line_no) % {len(CODE_LINES)} + 1] ELSE line END AS line FROM output_lines_v)),
k AS (SELECT *, p - coalesce(lag(p) OVER (PARTITION BY output_id ORDER BY p), 0) - 1 AS gap FROM (SELECT *, count(*) FILTER (p > 6 AND imp) OVER (PARTITION BY output_id ORDER BY p) AS rk FROM c) WHERE total <= 12 OR p <= 6 OR (imp AND rk <= 5))
SELECT output_id, line_no, 1 AS sub, line FROM k
UNION ALL SELECT output_id, line_no, 0, '    // ... ' || gap || ' lines omitted' FROM k WHERE gap > 0
UNION ALL SELECT output_id, max(line_no) + 1, 2, '// ... ' || max(total) - count(*) - count(*) FILTER (gap > 0) || ' more lines (total: ' || max(total) || ')' FROM k WHERE total > 12 GROUP BY 1""")
def win_smart_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return op.smart_truncate(code_lines(spark, sf), 12)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0.01 THEN format('${:.2f}', x) ELSE format('${:.4f}', x) END AS shown FROM (SELECT *, l_orderkey / 4096.0::DOUBLE + 0.0001 - 14 AS x FROM lineitem)")
def fn_format_usd(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", num.format_usd(col("l_orderkey") / 4096.0 + 0.0001 - 14).alias("shown"))


@query("SELECT event_id, CASE WHEN x <= 0 THEN '$0.00/MTok' ELSE format('${:.2f}/MTok', x * 1000000.0::DOUBLE) END AS shown FROM (SELECT event_id, (event_id % 4096 - 100) / 268435456.0::DOUBLE AS x FROM events)")
def fn_format_cpt(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "events").select("event_id", num.format_cpt((col("event_id") % 4096 - 100) / 268435456.0).alias("shown"))


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN format('{:.1f}M', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN format('{:.1f}K', n / 1024.0::DOUBLE) ELSE n || 'B' END AS shown FROM (SELECT doc_id, n_chars * 37::BIGINT AS n FROM documents)")
def fn_human_size(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "documents").select("doc_id", num.human_size(col("n_chars").cast("long") * 37).alias("shown"))
