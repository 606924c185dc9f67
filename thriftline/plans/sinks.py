"""Queries that write an export to the shared folder and return what reading it back gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.operators import corrections, economics, telemetry
from thriftline.plans import economics as econ
from thriftline.plans.registry import query
from thriftline.session import shared_path
from thriftline.sinks import export, retained
from thriftline.sinks.store import Store
from thriftline.sources import derived as d

PERIODS = {"daily": "strftime(ts, '%Y-%m-%d')", "weekly": "strftime(date_trunc('week', ts), '%Y-%m-%d')", "monthly": "strftime(ts, '%Y-%m')"}
PCT = "CASE WHEN sum(input_tokens) > 0 THEN sum(saved_tokens) * 100.0::DOUBLE / sum(input_tokens) ELSE 0 END"
SUMS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_tokens)::BIGINT AS saved_tokens"


def store(spark: SparkSession, name: str) -> Store:
    return Store(spark, shared_path(spark, name), keep=1)


def section_sql(section: str, rows: str, order: str, name: str, commands: str, out: str, pct: str, time: str, limit: int = 0, tokens: str = "input_tokens") -> str:
    ranked = f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({rows})"
    return f"SELECT '{section}' AS section, place::INT AS place, {name} AS name, {commands}::BIGINT AS commands, {tokens}::BIGINT AS input_tokens, {out}::BIGINT AS output_tokens, saved_tokens::BIGINT AS saved_tokens, round({pct}, 6) AS pct, {time}::BIGINT AS time_ms FROM ({ranked})" + (f" WHERE place <= {limit}" if limit else "")


SUMMARY_SQL = f"SELECT 'summary' AS section, 1 AS place, '1.0' AS name, count(*) AS commands, {SUMS}, round({PCT}, 6) AS pct, (sum(exec_time_ms) // count(*))::BIGINT AS time_ms FROM commands_v"


def by_command_sql(limit: int) -> str:
    rows = "SELECT filtered_cmd, count(*) AS c, sum(input_tokens) AS input_tokens, sum(saved_tokens) AS saved_tokens, avg(savings_pct) AS p, floor(avg(exec_time_ms)) AS t FROM commands_v GROUP BY 1"
    return section_sql("by_command", rows, "saved_tokens DESC, filtered_cmd", "filtered_cmd", "c", "NULL", "p", "t", limit)


def period_sql(g: str) -> str:
    return section_sql(g, f"SELECT {PERIODS[g]} AS k, count(*) AS c, {SUMS}, {PCT} AS p, sum(exec_time_ms) // count(*) AS t FROM commands_v GROUP BY 1", "k", "k", "c", "output_tokens", "p", "t")


@query(" UNION ALL ".join([SUMMARY_SQL, by_command_sql(3), section_sql("history", "SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS k FROM commands_v", "ts DESC, id DESC", "k", "NULL", "output_tokens", "savings_pct", "NULL", 3), *map(period_sql, PERIODS)]))
def sink_gain_json(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document, with the three best commands and latest runs."""
    to = store(spark, "gain-json")
    export.write_gain(d.commands(spark, sf), to, daily=True, weekly=True, monthly=True, history=True, limit=3)
    return export.document_rows(spark.read.text(to.at("gain")).withColumnRenamed("value", "doc"))


@query(" UNION ALL ".join([SUMMARY_SQL, by_command_sql(50), section_sql("by_project", "SELECT project_path, count(*) AS c, sum(saved_tokens) AS saved_tokens, avg(savings_pct) AS p FROM commands_v WHERE project_path <> '' GROUP BY 1", "saved_tokens DESC, project_path", "project_path", "c", "NULL", "p", "NULL", tokens="NULL")]))
def sink_gain_projects_json(spark: SparkSession, sf: str) -> DataFrame:
    to = store(spark, "gain-projects")
    export.write_gain(d.commands(spark, sf), to, projects=True)
    return export.document_rows(spark.read.text(to.at("gain")).withColumnRenamed("value", "doc"))


def csv_sql(g: str) -> str:
    end = "strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')" if g == "weekly" else "NULL"
    return f"SELECT '{g}' AS granularity, {PERIODS[g]} AS date, {end} AS week_end, count(*) AS commands, {SUMS}, printf('%.2f', {PCT}) AS savings_pct, sum(exec_time_ms)::BIGINT AS total_time_ms, (sum(exec_time_ms) // count(*))::BIGINT AS avg_time_ms FROM commands_v GROUP BY ALL"


@query(" UNION ALL ".join(map(csv_sql, PERIODS)))
def sink_gain_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Three delimited tables with headers."""
    to, out = store(spark, "gain-csv"), None
    export.write_csv(d.commands(spark, sf), to)
    for g in PERIODS:
        rows = export.read_csv(spark, to, g).withColumn("granularity", F.lit(g))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def economics_sql(g: str, view: str, key: str) -> str:
    money = lambda c: f"coalesce(printf('%.4f', {c}), '')"
    text = lambda c: f"coalesce({c}::VARCHAR, '')"
    return f"""SELECT '{g}' AS granularity, '' AS scope_project_path, 'global' AS ccusage_scope, k AS period, {money("e.total_cost")} AS spent, {text("e.input_tokens")} AS input_tokens, {text("e.output_tokens")} AS output_tokens, {text("e.cache_creation_tokens")} AS cache_create,
  {text("e.cache_read_tokens")} AS cache_read, {text("active")} AS active_tokens, {text("e.total_tokens")} AS total_tokens, {text("e.saved_tokens")} AS saved_tokens, {money("w")} AS weighted_savings, {money("a")} AS active_savings, {money("b")} AS blended_savings, {text("e.commands")} AS tracked_commands
FROM (SELECT *, {key} AS k, input_tokens + output_tokens AS active, saved_tokens * (total_cost / ({econ.WEIGHTED})) AS w, saved_tokens * (total_cost / (input_tokens + output_tokens)) AS a, saved_tokens * (total_cost / total_tokens) AS b FROM {view}) e"""


@query(" UNION ALL ".join([economics_sql("daily", "econ_day_v", "strftime(day, '%Y-%m-%d')"), economics_sql("weekly", "econ_week_v", "strftime(week_start, '%Y-%m-%d')"), economics_sql("monthly", "econ_month_v", "month")]))
def sink_economics(spark: SparkSession, sf: str) -> DataFrame:
    """Three delimited tables of all columns; the totals go to a document beside them."""
    of = lambda df: economics.dual(economics.weighted(df))
    to, out = store(spark, "economics"), None
    months = econ.by_month(spark, sf)
    export.write_economics({"daily": (of(econ.by_day(spark, sf)), "day"), "weekly": (of(econ.by_week(spark, sf)), "week_start"), "monthly": (of(months), "month")}, to, economics.period_sums(months))
    for g in PERIODS:
        rows = export.read_economics(spark, to, g).withColumn("granularity", F.lit(g))
        out = rows if out is None else out.unionByName(rows)
    return out


@query('SELECT wrong_pattern AS wrong, right_pattern AS "right" FROM rules_v')
def sink_rules_json(spark: SparkSession, sf: str) -> DataFrame:
    to = store(spark, "rules")
    rules = corrections.rules(corrections.corrections(d.tool_calls(spark, sf))).select(F.col("wrong_pattern").alias("wrong"), F.col("right_pattern").alias("right"))
    to.commit({"rules": (rules, "json", {})})
    return spark.read.schema("wrong string, right string").json(to.at("rules"))


def entries_sql(part: str, rows: str, order: str, name: str, commands: str, most: int) -> str:
    """The first entries of a part of the telemetry document; its order is that in which they stand there, days from the first of the last on."""
    kept = f"SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM ({rows})"
    place = "row_number() OVER (ORDER BY r DESC)" if part == "days" else "r"
    return f"SELECT '{part}' AS part, count(*) OVER () AS n, {place}::INT AS place, {name} AS name, {commands} AS commands, NULL::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens, s AS saved_tokens, NULL::BIGINT AS time_ms FROM ({kept}) WHERE r <= {most}"


def top_sql(part: str, key: str, condition: str) -> str:
    rows = f"SELECT {key}, count(*) AS c, sum(saved_tokens)::BIGINT AS s FROM commands_v WHERE {condition} GROUP BY 1"
    return entries_sql(part, rows, f"s DESC, {key}", key, "c", 10)


DOC_SUMMARY_SQL = "SELECT 'summary' AS part, 1::BIGINT AS n, 1 AS place, NULL AS name, count(*) AS commands, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_tokens)::BIGINT AS saved_tokens, sum(exec_time_ms)::BIGINT AS time_ms FROM commands_v"
DOC_DAYS = "SELECT CAST(ts AS DATE) AS k, sum(saved_tokens)::BIGINT AS s FROM commands_v GROUP BY 1"


@query(" UNION ALL ".join(f"({x})" for x in (DOC_SUMMARY_SQL, top_sql("projects", "project_path", "project_path <> ''"), top_sql("commands", "filtered_cmd", "true"), entries_sql("days", DOC_DAYS, "k DESC", "strftime(k, '%Y-%m-%d')", "NULL::BIGINT", 30))))
def sink_telemetry_doc(spark: SparkSession, sf: str) -> DataFrame:
    """The telemetry document, written as JSON and read back whole: its totals and all entries of its parts in their order, with how many a part has."""
    doc, to = telemetry.telemetry_document(d.commands(spark, sf)), store(spark, "telemetry")
    to.commit({"telemetry": (doc.coalesce(1), "json", {})})
    back = spark.read.schema(doc.schema).json(to.at("telemetry"))
    none = F.lit(None).cast("long")

    def entries(part: str, listed: str, name: str, commands: str | None) -> DataFrame:
        rows = back.select(F.lit(part).alias("part"), F.size(listed).cast("long").alias("n"), F.posexplode(listed).alias("i", "e"))
        said = F.col(f"e.{commands}") if commands else none
        return rows.select("part", "n", (F.col("i") + 1).alias("place"), F.col(f"e.{name}").cast("string").alias("name"), said.alias("commands"), none.alias("input_tokens"), none.alias("output_tokens"), F.col("e.saved_tokens").alias("saved_tokens"), none.alias("time_ms"))

    total = back.select(
        F.lit("summary").alias("part"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("name"), F.col("summary.total_commands").alias("commands"),
        F.col("summary.total_input").alias("input_tokens"), F.col("summary.total_output").alias("output_tokens"), F.col("summary.total_saved").alias("saved_tokens"), F.col("summary.total_time_ms").alias("time_ms"),
    )
    return total.unionByName(entries("projects", "by_project", "project_path", "commands")).unionByName(entries("commands", "by_command", "filtered_cmd", "commands")).unionByName(entries("days", "daily", "day", None))


CAP = 4096


@query(f"""SELECT file_name, output_id, CASE WHEN strlen(text) > {CAP} THEN (SELECT max(strlen(left(text, k::INT))) FROM range({CAP // 4}, {CAP + 1}) r(k) WHERE strlen(left(text, k::INT)) <= {CAP}) + length(note) ELSE strlen(text) END::BIGINT AS bytes FROM (
SELECT *, chr(10) || chr(10) || '--- truncated at {CAP} bytes ---' AS note, row_number() OVER (ORDER BY file_name DESC) AS n FROM (
SELECT *, lpad((1700000000 + output_id)::VARCHAR, 10, '0') || '_' || substr(regexp_replace(command, '[^A-Za-z0-9_-]', '_', 'g'), 1, 40) || '.log' AS file_name FROM outputs_v WHERE strlen(text) >= 500 AND exit_code <> 0)) WHERE n <= 20""")
def sink_retain_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Failed outputs in two runs: the newest twenty files of both stay, each of at most CAP bytes and a note."""
    to = store(spark, "retained")
    outputs = d.outputs(spark, sf).withColumn("captured_at", F.col("output_id") + 1_700_000_000)
    for code in (1, 2):
        retained.retain(outputs.filter(F.col("exit_code") == code), to, most_bytes=CAP)
    return retained.kept(to).select("file_name", "output_id", F.octet_length("content").cast("long").alias("bytes"))
