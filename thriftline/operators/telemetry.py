"""Savings analytics over the command fact table. Every operator takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions.numbers import share_pct

#: Monthly token quota of the base tier, and the tiers' multiples of it.
QUOTA_TOKENS = 6_000_000
QUOTA_TIERS = {"pro": 1, "5x": 5, "20x": 20}


def in_project(df: DataFrame, path: str | None, col: str = "project_path") -> DataFrame:
    """Rows of a project: exactly path, or below it. All rows for None; characters of path have no special meaning."""
    return df if path is None else df.filter((F.col(col) == path) | F.col(col).startswith(path.rstrip("/") + "/"))


def find_project(df: DataFrame, name: str, col: str = "project_path") -> str | None:
    """The one project path that holds name, whatever the case; None for "all". No match, or several, is an error."""
    if name.lower() == "all":
        return None
    found = [r[0] for r in df.select(col).filter(F.lower(col).contains(name.lower())).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} project matches {name!r}")
    return found[0]


def since_days(df: DataFrame, days: int, as_of: str, col: str = "ts") -> DataFrame:
    """Rows of the last days before as_of; all rows for 0."""
    return df if days == 0 else df.filter(F.col(col) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def with_execution_kind(df: DataFrame) -> DataFrame:
    """Fill in the kind of legacy rows: what saved nothing and ran as it came was passed through."""
    legacy = F.when((F.col("input_tokens") == 0) & (F.col("output_tokens") == 0), "passthrough").otherwise("filtered")
    return df.withColumn("execution_kind", F.coalesce("execution_kind", legacy))


def totals(df: DataFrame) -> DataFrame:
    """One row: counts and sums, savings as the ratio of sums, whole milliseconds on average."""
    t = df.agg(
        F.count("*").alias("total_commands"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("total_saved"), F.coalesce(F.sum("exec_time_ms"), F.lit(0)).alias("total_time_ms"),
    )
    avg = F.when(F.col("total_commands") > 0, F.expr("total_time_ms div total_commands")).otherwise(0)
    return t.withColumn("savings_pct", share_pct(F.col("total_saved"), F.col("total_input"))).withColumn("avg_time_ms", avg.cast("long"))


def by_command(df: DataFrame) -> DataFrame:
    """Per filtered command; the percentage is the mean of the rows' percentages."""
    return df.groupBy("filtered_cmd").agg(
        F.count("*").alias("commands"), F.sum("input_tokens").alias("input_tokens"), F.sum("saved_tokens").alias("saved_tokens"),
        F.avg("savings_pct").alias("avg_savings_pct"), F.floor(F.avg("exec_time_ms")).cast("long").alias("avg_time_ms"),
    )


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The first k rows by one column downwards, ties upwards: one sort with a limit, no shuffle of the rest."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in ties]).limit(k)


def periods(df: DataFrame, key: Column, name: str = "period") -> DataFrame:
    """Per period: counts, sums, savings as the ratio of sums, whole milliseconds on average."""
    p = df.groupBy(key.alias(name)).agg(
        F.count("*").alias("commands"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("saved_tokens").alias("saved_tokens"), F.sum("exec_time_ms").alias("total_time_ms"),
    )
    return p.withColumn("savings_pct", share_pct(F.col("saved_tokens"), F.col("input_tokens"))).withColumn("avg_time_ms", F.expr("total_time_ms div commands").cast("long"))


def days(df: DataFrame) -> DataFrame:
    return periods(df, F.to_date("ts"), "day")


def weeks(df: DataFrame) -> DataFrame:
    """Weeks from Monday, with their Sunday."""
    return periods(df, F.to_date(F.date_trunc("week", "ts")), "week_start").withColumn("week_end", F.date_add("week_start", 6))


def months(df: DataFrame) -> DataFrame:
    return periods(df, F.date_format("ts", "yyyy-MM"), "month")


def recent_days(df: DataFrame, k: int = 30) -> DataFrame:
    """Saved tokens of the last k active days, oldest first."""
    saved = df.groupBy(F.to_date("ts").alias("day")).agg(F.sum("saved_tokens").alias("saved_tokens"))
    return saved.orderBy(F.desc("day")).limit(k).orderBy("day")


def share_of_best(df: DataFrame, value: str, width: int = 40) -> DataFrame:
    """A bar length for each row: its share of the largest value, in width steps."""
    best = F.max(value).over(Window.partitionBy())
    return df.withColumn("bar", F.when(best > 0, F.floor(F.col(value) * width / best)).otherwise(0).cast("long"))


def period_totals(p: DataFrame) -> DataFrame:
    """The footer of a table of periods."""
    t = p.agg(*[F.sum(c).alias(c) for c in ("commands", "input_tokens", "output_tokens", "saved_tokens", "total_time_ms")])
    return t.withColumn("savings_pct", share_pct(F.col("saved_tokens"), F.col("input_tokens"))).withColumn("avg_time_ms", F.when(F.col("commands") > 0, F.expr("total_time_ms div commands")).otherwise(0).cast("long"))


def by_project(df: DataFrame) -> DataFrame:
    """Per project path that is set; the name is the latest that is not blank."""
    named = F.when(F.trim("project_name") != "", F.struct("ts", "id", "project_name"))
    return df.filter("project_path <> ''").groupBy("project_path").agg(
        F.count("*").alias("commands"), F.sum("saved_tokens").alias("saved_tokens"), F.avg("savings_pct").alias("avg_savings_pct"),
        F.max("ts").alias("last_used"), F.max(named)["project_name"].alias("project_name"),
    )


def passthrough(df: DataFrame) -> DataFrame:
    """Per original command that ran unfiltered: count and time."""
    return df.filter(F.col("execution_kind") == "passthrough").groupBy("original_cmd").agg(F.count("*").alias("commands"), F.sum("exec_time_ms").alias("total_time_ms"))


def parse_failures(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("failures"), F.coalesce(F.avg(F.col("fallback_succeeded").cast("int")) * 100, F.lit(0.0)).alias("recovery_pct"))


def parse_health(df: DataFrame) -> DataFrame:
    """Counts per command and parse tier; rows without a tier do not count."""
    return df.filter("parse_tier > 0").groupBy("filtered_cmd", "parse_tier").agg(F.count("*").alias("commands"))


def parse_health_pivot(df: DataFrame) -> DataFrame:
    """A row per command: commands by tier, share of the first tier, and flags for degraded and raw results."""
    p = df.filter("parse_tier > 0").groupBy("filtered_cmd").pivot("parse_tier", [1, 2, 3]).count().na.fill(0, ["1", "2", "3"])
    p = p.select("filtered_cmd", F.col("1").alias("full"), F.col("2").alias("degraded"), F.col("3").alias("raw"), (F.col("1") + F.col("2") + F.col("3")).alias("commands"))
    healthy = F.expr("full * 100 div commands").cast("long")
    worse = 100 - healthy
    return p.withColumn("healthy_pct", healthy).withColumn("flag", F.when(worse > 25, "bad").when(worse > 10, "warn").otherwise("ok"))


def quality_score(coverage_pct: Column, recovery_pct: Column) -> Column:
    """Seven parts coverage, three parts recovery, within 0 to 100."""
    return F.least(F.greatest(coverage_pct * 0.7 + recovery_pct * 0.3, F.lit(0.0)), F.lit(100.0))


def quota(df: DataFrame) -> DataFrame:
    """Saved tokens beside each tier's monthly quota."""
    tiers = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(QUOTA_TOKENS * m).cast("long").alias("quota_tokens")) for k, m in QUOTA_TIERS.items()])
    one = df.agg(F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    return one.select("saved_tokens", F.inline(tiers)).withColumn("quota_pct", share_pct(F.col("saved_tokens"), F.col("quota_tokens")))


def telemetry_document(df: DataFrame, k: int = 10) -> DataFrame:
    """One nested row: totals, top commands, projects, days. Each part is aggregated before it is gathered."""
    total = totals(df).select(F.lit(1).alias("one"), F.struct("*").alias("summary"))
    commands = top(by_command(df), k, "saved_tokens", "filtered_cmd").agg(F.sort_array(F.collect_list(F.struct((-F.col("saved_tokens")).alias("order"), "filtered_cmd", "commands", "saved_tokens"))).alias("by_command"))
    projects = top(by_project(df), k, "saved_tokens", "project_path").agg(F.sort_array(F.collect_list(F.struct((-F.col("saved_tokens")).alias("order"), "project_path", "commands", "saved_tokens"))).alias("by_project"))
    daily = recent_days(df).agg(F.sort_array(F.collect_list(F.struct("day", "saved_tokens"))).alias("daily"))
    for part in (commands, projects, daily):
        total = total.join(part.withColumn("one", F.lit(1)), "one")
    return total.drop("one")
