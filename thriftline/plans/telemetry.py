"""Queries of the savings telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import numbers
from thriftline.operators import audit
from thriftline.operators import telemetry as t
from thriftline.plans.registry import query
from thriftline.sources import derived as d

PERIOD = """count(*) AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, sum(exec_time_ms)::BIGINT AS total_time_ms,
  CASE WHEN sum(input_tokens) > 0 THEN sum(saved_tokens) * 100.0::DOUBLE / sum(input_tokens) ELSE 0 END AS savings_pct, (sum(exec_time_ms) // count(*))::BIGINT AS avg_time_ms"""
SUMMARY = """count(*) AS total_commands, coalesce(sum(input_tokens), 0)::BIGINT AS total_input, coalesce(sum(output_tokens), 0)::BIGINT AS total_output, coalesce(sum(saved_tokens), 0)::BIGINT AS total_saved,
  coalesce(sum(exec_time_ms), 0)::BIGINT AS total_time_ms, CASE WHEN sum(input_tokens) > 0 THEN sum(saved_tokens) * 100.0::DOUBLE / sum(input_tokens) ELSE 0 END AS savings_pct, CASE WHEN count(*) > 0 THEN sum(exec_time_ms) // count(*) ELSE 0 END::BIGINT AS avg_time_ms"""
COMMAND = """filtered_cmd, count(*) AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, avg(savings_pct) AS avg_savings_pct, floor(avg(exec_time_ms))::BIGINT AS avg_time_ms"""
PROJECT = """project_path, count(*) AS commands, sum(saved_tokens)::BIGINT AS saved_tokens, avg(savings_pct) AS avg_savings_pct, max(ts) AS last_used,
  arg_max(project_name, {'t': ts, 'i': id}) FILTER (trim(project_name) <> '') AS project_name"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(f"SELECT {SUMMARY} FROM commands_v")
def agg_summary(spark: SparkSession, sf: str) -> DataFrame:
    return t.totals(d.commands(spark, sf))


@query(f"SELECT {SUMMARY} FROM commands_v WHERE project_path = '/w/p3' OR starts_with(project_path, '/w/p3/')")
def flt_project_scope(spark: SparkSession, sf: str) -> DataFrame:
    return t.totals(t.in_project(d.commands(spark, sf), "/w/p3"))


@query(f"SELECT {SUMMARY} FROM commands_v WHERE ts >= TIMESTAMP '{d.AS_OF}' - INTERVAL 30 DAY")
def flt_since_days(spark: SparkSession, sf: str) -> DataFrame:
    return t.totals(t.since_days(d.commands(spark, sf), 30, d.AS_OF))


@query("SELECT execution_kind, count(*) AS commands FROM (SELECT CASE WHEN id % 5 <> 0 THEN execution_kind WHEN input_tokens = 0 AND output_tokens = 0 THEN 'passthrough' ELSE 'filtered' END AS execution_kind FROM commands_v) GROUP BY 1")
def flt_execution_kind(spark: SparkSession, sf: str) -> DataFrame:
    legacy = d.commands(spark, sf).withColumn("execution_kind", F.when(F.col("id") % 5 != 0, F.col("execution_kind")))
    return t.with_execution_kind(legacy).groupBy("execution_kind").agg(F.count("*").alias("commands"))


@query(f"SELECT {COMMAND} FROM commands_v GROUP BY filtered_cmd ORDER BY saved_tokens DESC, filtered_cmd LIMIT 10")
def agg_by_command(spark: SparkSession, sf: str) -> DataFrame:
    return t.top(t.by_command(d.commands(spark, sf)), 10, "saved_tokens", "filtered_cmd")


@query("SELECT original_cmd, sum(saved_tokens)::BIGINT AS saved_tokens FROM commands_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return t.top(d.commands(spark, sf).groupBy("original_cmd").agg(F.sum("saved_tokens").alias("saved_tokens")), 20, "saved_tokens", "original_cmd")


@query("SELECT * FROM (SELECT CAST(ts AS DATE) AS day, sum(saved_tokens)::BIGINT AS saved_tokens FROM commands_v GROUP BY 1 ORDER BY 1 DESC LIMIT 30) ORDER BY day")
def agg_by_day_recent(spark: SparkSession, sf: str) -> DataFrame:
    return t.recent_days(d.commands(spark, sf))


@query("SELECT * FROM (SELECT CAST(ts AS DATE) AS day, sum(saved_tokens)::BIGINT AS saved_tokens FROM commands_v GROUP BY 1 ORDER BY 1 DESC LIMIT 7) ORDER BY day")
def latest_then_ascending(spark: SparkSession, sf: str) -> DataFrame:
    return t.recent_days(d.commands(spark, sf), 7)


@query("SELECT *, floor(saved_tokens * 40 / max(saved_tokens) OVER ())::BIGINT AS bar FROM (SELECT CAST(ts AS DATE) AS day, sum(saved_tokens)::BIGINT AS saved_tokens FROM commands_v GROUP BY 1 ORDER BY 1 DESC LIMIT 30)")
def win_rank_period_share(spark: SparkSession, sf: str) -> DataFrame:
    return t.share_of_best(t.recent_days(d.commands(spark, sf)), "saved_tokens")


@query(f"SELECT CAST(ts AS DATE) AS day, {PERIOD} FROM commands_v GROUP BY 1")
def agg_days(spark: SparkSession, sf: str) -> DataFrame:
    return t.days(d.commands(spark, sf))


@query(f"SELECT *, week_start + 6 AS week_end FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, {PERIOD} FROM commands_v GROUP BY 1)")
def agg_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return t.weeks(d.commands(spark, sf))


@query(f"SELECT strftime(ts, '%Y-%m') AS month, {PERIOD} FROM commands_v GROUP BY 1")
def agg_months(spark: SparkSession, sf: str) -> DataFrame:
    return t.months(d.commands(spark, sf))


@query(f"SELECT {PERIOD} FROM commands_v")
def agg_period_totals(spark: SparkSession, sf: str) -> DataFrame:
    return t.period_totals(t.days(d.commands(spark, sf)))


@query(f"SELECT {PROJECT} FROM commands_v WHERE project_path <> '' GROUP BY project_path")
def agg_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(t.by_project(d.commands(spark, sf)), "last_used")


@query("SELECT project_path, arg_max(project_name, {'t': ts, 'i': id}) AS project_name FROM commands_v WHERE project_path <> '' AND trim(project_name) <> '' GROUP BY 1")
def join_latest_project_name(spark: SparkSession, sf: str) -> DataFrame:
    return t.by_project(d.commands(spark, sf)).filter("project_name is not null").select("project_path", "project_name")


@query("SELECT original_cmd, count(*) AS commands, sum(exec_time_ms)::BIGINT AS total_time_ms FROM commands_v WHERE execution_kind = 'passthrough' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    return t.top(t.passthrough(d.commands(spark, sf)), 5, "commands", "original_cmd")


@query("SELECT id, ts, filtered_cmd, input_tokens, saved_tokens FROM commands_v ORDER BY ts DESC, id DESC LIMIT 10")
def recent_k(spark: SparkSession, sf: str) -> DataFrame:
    df = d.commands(spark, sf).select("id", "ts", "filtered_cmd", "input_tokens", "saved_tokens")
    return ntz(df.orderBy(F.desc("ts"), F.desc("id")).limit(10), "ts")


@query("SELECT count(*) AS failures, coalesce(avg(fallback_succeeded::INT) * 100, 0) AS recovery_pct FROM parse_failures_v")
def agg_parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    return t.parse_failures(d.parse_failures(spark, sf))


@query("SELECT raw_command, count(*) AS failures FROM parse_failures_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_parse_failure_commands(spark: SparkSession, sf: str) -> DataFrame:
    return t.top(d.parse_failures(spark, sf).groupBy("raw_command").agg(F.count("*").alias("failures")), 10, "failures", "raw_command")


@query(f"SELECT filtered_cmd, parse_tier, count(*) AS commands FROM commands_v WHERE parse_tier > 0 AND ts >= TIMESTAMP '{d.AS_OF}' - INTERVAL 60 DAY GROUP BY 1, 2")
def agg_parse_health(spark: SparkSession, sf: str) -> DataFrame:
    return t.parse_health(t.since_days(d.commands(spark, sf), 60, d.AS_OF))


@query("""SELECT *, CASE WHEN 100 - healthy_pct > 25 THEN 'bad' WHEN 100 - healthy_pct > 10 THEN 'warn' ELSE 'ok' END AS flag FROM (
SELECT filtered_cmd, count(*) FILTER (parse_tier = 1) AS "full", count(*) FILTER (parse_tier = 2) AS degraded, count(*) FILTER (parse_tier = 3) AS raw, count(*) AS commands,
  (count(*) FILTER (parse_tier = 1) * 100 // count(*))::BIGINT AS healthy_pct FROM commands_v WHERE parse_tier > 0 GROUP BY 1)""")
def agg_parse_health_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return t.parse_health_pivot(d.commands(spark, sf))


AUDIT = "(SELECT f[1] AS ts, f[2] AS action, f[3] AS original_cmd, coalesce(f[4], '-') AS rewritten_cmd FROM (SELECT string_split(value, ' | ') AS f FROM audit_lines_v) WHERE len(f) >= 3)"
ACTIONABLE = ", ".join(f"'{a}'" for a in audit.ACTIONABLE)


@query(f"SELECT strptime(ts, '%Y-%m-%d %H:%M:%S') AS ts, action, original_cmd, rewritten_cmd FROM {AUDIT}")
def src_hook_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(audit.entries(d.audit_lines(spark, sf)), "ts")


@query(f"""SELECT *, total - rewrites AS skips, rewrites * 100.0::DOUBLE / total AS rewrite_pct, CASE WHEN actionable = 0 THEN 100.0 ELSE rewrites * 100.0::DOUBLE / actionable END AS coverage_pct
FROM (SELECT count(*) AS total, count(*) FILTER (action = 'rewrite') AS rewrites, count(*) FILTER (action IN ({ACTIONABLE})) AS actionable FROM {AUDIT})""")
def agg_hook_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.summary(audit.entries(d.audit_lines(spark, sf)))


@query(f"SELECT count(*) AS entries FROM {AUDIT} WHERE action IN ({ACTIONABLE})")
def flt_actionable(spark: SparkSession, sf: str) -> DataFrame:
    return audit.entries(d.audit_lines(spark, sf)).filter(F.col("action").isin(*audit.ACTIONABLE)).agg(F.count("*").alias("entries"))


@query(f"SELECT substr(action, 6) AS reason, count(*) AS entries FROM {AUDIT} WHERE starts_with(action, 'skip:') GROUP BY 1")
def agg_skip_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return audit.skip_reasons(audit.entries(d.audit_lines(spark, sf)))


@query(f"SELECT array_to_string(list_slice(list_filter(string_split(original_cmd, ' '), lambda w: NOT contains(w, '=')), 1, 2), ' ') AS base_cmd, count(*) AS entries FROM {AUDIT} WHERE action = 'rewrite' GROUP BY 1")
def agg_top_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    return audit.rewritten_commands(audit.entries(d.audit_lines(spark, sf)))


@query(f"""SELECT least(greatest(c * 0.7 + r * 0.3, 0), 100) AS quality_score FROM
(SELECT count(*) FILTER (action = 'rewrite') * 100.0::DOUBLE / count(*) FILTER (action IN ({ACTIONABLE})) AS c FROM {AUDIT}), (SELECT avg(fallback_succeeded::INT) * 100 AS r FROM parse_failures_v)""")
def agg_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    coverage = audit.summary(audit.entries(d.audit_lines(spark, sf))).select("coverage_pct", F.lit(1).alias("one"))
    recovery = t.parse_failures(d.parse_failures(spark, sf)).select("recovery_pct", F.lit(1).alias("one"))
    return coverage.join(recovery, "one").select(t.quality_score(F.col("coverage_pct"), F.col("recovery_pct")).alias("quality_score"))


@query("SELECT saved_tokens, tier, quota_tokens, saved_tokens * 100.0::DOUBLE / quota_tokens AS quota_pct FROM (SELECT sum(saved_tokens)::BIGINT AS saved_tokens FROM commands_v), (VALUES ('pro', 6000000::BIGINT), ('5x', 30000000), ('20x', 120000000)) q(tier, quota_tokens)")
def agg_quota(spark: SparkSession, sf: str) -> DataFrame:
    return t.quota(d.commands(spark, sf))


@query("""SELECT total_commands, total_saved, by_command, by_project, n_days FROM
(SELECT count(*) AS total_commands, sum(saved_tokens)::BIGINT AS total_saved FROM commands_v),
(SELECT string_agg(filtered_cmd || '=' || s, ',' ORDER BY s DESC, filtered_cmd) AS by_command FROM (SELECT filtered_cmd, sum(saved_tokens)::BIGINT AS s FROM commands_v GROUP BY 1 ORDER BY s DESC, 1 LIMIT 10)),
(SELECT string_agg(project_path || '=' || s, ',' ORDER BY s DESC, project_path) AS by_project FROM (SELECT project_path, sum(saved_tokens)::BIGINT AS s FROM commands_v WHERE project_path <> '' GROUP BY 1 ORDER BY s DESC, 1 LIMIT 10)),
(SELECT least(count(DISTINCT CAST(ts AS DATE)), 30)::INT AS n_days FROM commands_v)""")
def agg_telemetry_doc(spark: SparkSession, sf: str) -> DataFrame:
    doc = t.telemetry_document(d.commands(spark, sf))
    said = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x["saved_tokens"])), ",")
    return doc.select("summary.total_commands", "summary.total_saved", said("by_command", "filtered_cmd").alias("by_command"), said("by_project", "project_path").alias("by_project"), F.size("daily").alias("n_days"))


@query("""SELECT id, ceil(length(original_cmd) / 4)::BIGINT AS tokens, greatest(input_tokens - output_tokens, 0) AS saved,
  CASE WHEN input_tokens > 0 AND output_tokens <= input_tokens THEN (input_tokens - output_tokens) * 100.0::DOUBLE / input_tokens ELSE 0 END AS pct,
  CASE WHEN input_tokens >= 1000000 THEN printf('%.1fM', input_tokens / 1e6) WHEN input_tokens >= 1000 THEN printf('%.1fK', input_tokens / 1e3) ELSE input_tokens::VARCHAR END AS shown_tokens,
  CASE WHEN exec_time_ms * 400 < 1000 THEN printf('%dms', exec_time_ms * 400) WHEN exec_time_ms * 400 < 60000 THEN printf('%.1fs', exec_time_ms * 400 / 1000.0::DOUBLE) ELSE printf('%dm%ds', (exec_time_ms * 400) // 60000, (exec_time_ms * 400 % 60000) // 1000) END AS shown_time
FROM commands_v""")
def fn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """fn_estimate_tokens, fn_savings, fn_compare_savings, fn_format_tokens and fn_format_duration on every command."""
    tin, tout = F.col("input_tokens"), F.col("output_tokens")
    return d.commands(spark, sf).select(
        "id", numbers.estimate_tokens(F.col("original_cmd")).alias("tokens"), numbers.saved_tokens(tin, tout).alias("saved"), numbers.compare_savings(tin, tout)[1].alias("pct"),
        numbers.format_tokens(tin).alias("shown_tokens"), numbers.format_duration(F.col("exec_time_ms") * 400).alias("shown_time"),
    )
