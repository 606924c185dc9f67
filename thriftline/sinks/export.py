"""Exports of savings and economics as documents and delimited files, and the rows that reading them back gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions.numbers import fixed
from thriftline.operators import telemetry as t
from thriftline.sinks.store import Store

#: The document's version, commands that a document of projects holds, and the columns of the delimited forms.
SCHEMA_VERSION, PROJECT_COMMANDS = "1.0", 50
PERIOD = ("date", "commands", "input_tokens", "output_tokens", "saved_tokens", "savings_pct", "total_time_ms", "avg_time_ms")
ECONOMICS = ("scope_project_path", "ccusage_scope", "period", "spent", "input_tokens", "output_tokens", "cache_create", "cache_read", "active_tokens", "total_tokens", "saved_tokens", "weighted_savings", "active_savings", "blended_savings", "tracked_commands")
SUMMARY = ("total_commands", "total_input", "total_output", "total_saved", "avg_savings_pct", "total_time_ms", "avg_time_ms")
COMMAND = ("command", "count", "input_tokens", "tokens_saved", "avg_savings_pct", "exec_time_ms")
PROJECT = ("project_path", "project_name", "commands", "saved_tokens", "avg_savings_pct", "last_used")
HISTORY = ("timestamp", "command", "project_path", "session_id", "input_tokens", "output_tokens", "saved_tokens", "savings_pct")
_LONGS = {"total_commands", "total_input", "total_output", "total_saved", "total_time_ms", "avg_time_ms", "count", "input_tokens", "output_tokens", "tokens_saved", "saved_tokens", "exec_time_ms", "commands"}
GRANULARITIES = ("daily", "weekly", "monthly")


def _ddl(fields: tuple[str, ...]) -> str:
    return ",".join(f"{f}:{'bigint' if f in _LONGS else 'double' if f.endswith('pct') else 'string'}" for f in fields)


DOCUMENT = f"schema_version string, summary struct<{_ddl(SUMMARY)}>, by_command array<struct<{_ddl(COMMAND)}>>, by_project array<struct<{_ddl(PROJECT)}>>, history array<struct<{_ddl(HISTORY)}>>, " + ", ".join(f"{g} array<struct<{_ddl(PERIOD)}>>" for g in GRANULARITIES)


def period_tables(commands: DataFrame) -> dict[str, DataFrame]:
    """Days, weeks and months with the columns of PERIOD; weeks with their week_end."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    out = {"daily": t.days(commands).withColumn("date", text("day")), "weekly": t.weeks(commands).withColumn("date", text("week_start")), "monthly": t.months(commands).withColumn("date", F.col("month"))}
    return {g: df.select(*PERIOD, *([text("week_end").alias("week_end")] if g == "weekly" else [])) for g, df in out.items()}


def _as_list(df: DataFrame, fields: tuple[str, ...], order: Column) -> DataFrame:
    """One row: the rows of an aggregate as a list, in the order of `order`."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("x"))))
    return df.agg(F.transform(rows, lambda r: r["x"]).alias("list"))


def gain_document(commands: DataFrame, daily: bool = False, weekly: bool = False, monthly: bool = False, history: bool = False, projects: bool = False, limit: int = 10, project: str | None = None) -> DataFrame:
    """One row (doc): the export as JSON text. Lists hold aggregates, or at most limit rows; a list not asked for is left out."""
    c = t.in_project(commands, project)
    limit = PROJECT_COMMANDS if projects else limit
    best = t.top(t.by_command(c).withColumnsRenamed({"filtered_cmd": "command", "commands": "count", "saved_tokens": "tokens_saved", "avg_time_ms": "exec_time_ms"}), limit, "tokens_saved", "command")
    doc = t.totals(c).withColumnRenamed("savings_pct", "avg_savings_pct").select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*SUMMARY).alias("summary"))
    lists = {"by_command": _as_list(best, COMMAND, F.struct(-F.col("tokens_saved"), F.col("command")))}
    if projects:
        by = t.by_project(c).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd'T'HH:mm:ss"))
        lists["by_project"] = _as_list(by, PROJECT, F.struct(-F.col("saved_tokens"), F.col("project_path")))
    if history:
        last = c.orderBy(F.desc("ts"), F.desc("id")).limit(limit).withColumns({"timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "command": F.col("filtered_cmd"), "project_path": F.coalesce("project_path", F.lit(""))})
        lists["history"] = _as_list(last, HISTORY, F.struct(-F.unix_micros("ts"), -F.col("id")))
    for name, df in period_tables(c).items():
        if {"daily": daily, "weekly": weekly, "monthly": monthly}[name]:
            lists[name] = _as_list(df, PERIOD, F.col("date"))
    for name, df in lists.items():
        doc = doc.crossJoin(df.withColumnRenamed("list", name))  # one row by one row
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("doc"))


def document_rows(docs: DataFrame) -> DataFrame:
    """A document (doc) as rows: section, place (from 1), name, counts, and percentages to six places."""
    d = docs.select(F.from_json("doc", DOCUMENT).alias("d")).select("d.*")
    one = d.select(F.lit("summary").alias("section"), F.lit(1).alias("place"), F.col("schema_version").alias("name"), F.col("summary.total_commands").alias("commands"), F.col("summary.total_input").alias("input_tokens"), F.col("summary.total_output").alias("output_tokens"), F.col("summary.total_saved").alias("saved_tokens"), F.col("summary.avg_savings_pct").alias("pct"), F.col("summary.avg_time_ms").alias("time_ms"))
    names = {
        "by_command": ("command", "count", "input_tokens", None, "tokens_saved", "avg_savings_pct", "exec_time_ms"), "by_project": ("project_path", "commands", None, None, "saved_tokens", "avg_savings_pct", None),
        "history": ("timestamp", None, "input_tokens", "output_tokens", "saved_tokens", "savings_pct", None), **dict.fromkeys(GRANULARITIES, ("date", "commands", "input_tokens", "output_tokens", "saved_tokens", "savings_pct", "avg_time_ms")),
    }
    out = one
    for section, fields in names.items():
        x = d.select(F.posexplode(section).alias("i", "x"))
        cols = [(F.col(f"x.{f}") if f else F.lit(None).cast("bigint")).alias(to) for f, to in zip(fields, ("name", "commands", "input_tokens", "output_tokens", "saved_tokens", "pct", "time_ms"))]
        out = out.unionByName(x.select(F.lit(section).alias("section"), (F.col("i") + 1).alias("place"), *cols))
    return out.withColumn("pct", F.round("pct", 6))


def write_gain(commands: DataFrame, store: Store, **what) -> int:
    """Commit a version with the document `gain`."""
    return store.commit({"gain": (gain_document(commands, **what).coalesce(1), "text", {})})


def write_csv(commands: DataFrame, store: Store) -> int:
    """Commit a version with a delimited table for each granularity: a header, percentages to two places, by date."""
    tables = {}
    for g, df in period_tables(commands).items():
        cols = [PERIOD[0], *(["week_end"] if g == "weekly" else []), *PERIOD[1:]]
        tables[g] = (df.withColumn("savings_pct", fixed(F.col("savings_pct"), 2)).select(*cols).orderBy("date"), "csv", {"header": "true"})
    return store.commit(tables)


def read_csv(spark: SparkSession, store: Store, granularity: str) -> DataFrame:
    cols = [PERIOD[0], *(["week_end"] if granularity == "weekly" else []), *PERIOD[1:]]
    schema = ", ".join(f"{c} {'bigint' if c in _LONGS else 'string'}" for c in cols)
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(store.at(granularity))


def economics_rows(periods: DataFrame, key: str, project: str | None = None) -> DataFrame:
    """The delimited form of economics (weighted and dual): all columns as text, money to four places, what a side lacks empty."""
    money = lambda c: fixed(F.col(c), 4)
    text = lambda c: F.col(c).cast("string")
    cols = {
        "scope_project_path": F.lit(project or ""), "ccusage_scope": F.lit("global"), "period": text(key), "spent": money("total_cost"), "input_tokens": text("input_tokens"), "output_tokens": text("output_tokens"), "cache_create": text("cache_creation_tokens"),
        "cache_read": text("cache_read_tokens"), "active_tokens": (F.col("input_tokens") + F.col("output_tokens")).cast("string"), "total_tokens": text("total_tokens"), "saved_tokens": text("saved_tokens"),
        "weighted_savings": money("weighted_savings"), "active_savings": money("active_savings"), "blended_savings": money("blended_savings"), "tracked_commands": text("commands"),
    }
    return periods.select(*[F.coalesce(cols[c], F.lit("")).alias(c) for c in ECONOMICS])


def write_economics(by_granularity: dict[str, tuple[DataFrame, str]], store: Store, totals: DataFrame) -> int:
    """Commit a version with delimited economics of each granularity (rows, key column) and the totals of all periods as JSON."""
    tables = {g: (economics_rows(df, key).orderBy("period"), "csv", {"header": "true", "emptyValue": ""}) for g, (df, key) in by_granularity.items()}
    return store.commit(tables | {"totals": (totals.coalesce(1), "json", {})})


def read_economics(spark: SparkSession, store: Store, granularity: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in ECONOMICS)).option("header", "true").csv(store.at(granularity)).na.fill("")
