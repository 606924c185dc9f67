"""Queries of spend and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.operators import economics as e
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d

SUMS = ", ".join(f"sum({c}) AS {c}" for c in e.SPENT)


def merged_sql(key_usage: str, key_commands: str, name: str) -> str:
    return f"""SELECT coalesce(u.k, s.k) AS {name}, u.* EXCLUDE (k), s.* EXCLUDE (k),
  CASE WHEN tracked_input > 0 THEN saved_tokens * 100.0::DOUBLE / tracked_input ELSE 0 END AS savings_pct,
  CASE WHEN saved_tokens + tracked_input + tracked_output > 0 THEN saved_tokens * 100.0::DOUBLE / (saved_tokens + tracked_input + tracked_output) ELSE 0 END AS savings_share_pct
FROM (SELECT {key_usage} AS k, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens,
  sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(total_tokens)::BIGINT AS total_tokens, sum(total_cost) AS total_cost FROM usage_daily_v GROUP BY 1) u
FULL JOIN (SELECT {key_commands} AS k, count(*) AS commands, sum(saved_tokens)::BIGINT AS saved_tokens, sum(input_tokens)::BIGINT AS tracked_input, sum(output_tokens)::BIGINT AS tracked_output FROM commands_v GROUP BY 1) s ON u.k = s.k"""


view("econ_day_v", merged_sql("day", "CAST(ts AS DATE)", "day"))
view("econ_week_v", merged_sql("CAST(date_trunc('week', day) AS DATE)", "CAST(date_trunc('week', ts) AS DATE)", "week_start"))
view("econ_month_v", merged_sql("strftime(day, '%Y-%m')", "strftime(ts, '%Y-%m')", "month"))
WEIGHTED = "input_tokens + 5.0::DOUBLE * output_tokens + 1.25::DOUBLE * cache_creation_tokens + 0.1::DOUBLE * cache_read_tokens"


def six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def six_sql(view_sql: str, doubles: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())}) FROM ({view_sql})"


def by_day(spark: SparkSession, sf: str) -> DataFrame:
    return e.merged(e.usage_by(d.usage_daily(spark, sf), F.col("day"), "day"), e.savings_by(d.commands(spark, sf), F.to_date("ts"), "day"), "day")


def by_week(spark: SparkSession, sf: str) -> DataFrame:
    week = lambda c: F.to_date(F.date_trunc("week", c))
    return e.merged(e.usage_by(d.usage_daily(spark, sf), week("day"), "week_start"), e.savings_by(d.commands(spark, sf), week("ts"), "week_start"), "week_start")


def by_month(spark: SparkSession, sf: str) -> DataFrame:
    month = lambda c: F.date_format(c, "yyyy-MM")
    return e.merged(e.usage_by(d.usage_daily(spark, sf), month("day"), "month"), e.savings_by(d.commands(spark, sf), month("ts"), "month"), "month")


MERGED = "total_cost savings_pct savings_share_pct"


@query(six_sql("SELECT * FROM econ_day_v", MERGED))
def join_economics_day(spark: SparkSession, sf: str) -> DataFrame:
    return six(by_day(spark, sf))


@query(six_sql("SELECT * FROM econ_week_v", MERGED))
def join_economics_week(spark: SparkSession, sf: str) -> DataFrame:
    return six(by_week(spark, sf))


@query(six_sql("SELECT * FROM econ_month_v", MERGED))
def join_economics_month(spark: SparkSession, sf: str) -> DataFrame:
    return six(by_month(spark, sf))


@query(f"""SELECT day, round(u, 6) AS weighted_units, round(c * 1e6, 6) AS weighted_cost_per_million, round(saved_tokens * c, 6) AS weighted_savings FROM (
SELECT *, CASE WHEN saved_tokens IS NOT NULL AND u > 0 THEN total_cost / u END AS c FROM (SELECT *, {WEIGHTED} AS u FROM econ_day_v))""")
def agg_econ_weighted(spark: SparkSession, sf: str) -> DataFrame:
    w = e.weighted(by_day(spark, sf))
    return w.select("day", F.round("weighted_units", 6).alias("weighted_units"), F.round(F.col("weighted_cpt") * 1e6, 6).alias("weighted_cost_per_million"), F.round("weighted_savings", 6).alias("weighted_savings"))


@query("""SELECT month, round(b * 1e6, 6) AS blended_per_million, round(a * 1e6, 6) AS active_per_million, round(saved_tokens * b, 6) AS blended_savings, round(saved_tokens * a, 6) AS active_savings FROM (
SELECT *, CASE WHEN total_tokens > 0 THEN total_cost / total_tokens END AS b, CASE WHEN input_tokens + output_tokens > 0 THEN total_cost / (input_tokens + output_tokens) END AS a FROM econ_month_v)""")
def agg_econ_dual(spark: SparkSession, sf: str) -> DataFrame:
    w = e.dual(by_month(spark, sf))
    return w.select("month", F.round(F.col("blended_cpt") * 1e6, 6).alias("blended_per_million"), F.round(F.col("active_cpt") * 1e6, 6).alias("active_per_million"), F.round("blended_savings", 6).alias("blended_savings"), F.round("active_savings", 6).alias("active_savings"))


@query(f"""SELECT total_tokens::BIGINT AS total_tokens, round(total_cost, 6) AS total_cost, saved_tokens::BIGINT AS saved_tokens, round(p, 6) AS avg_savings_pct, round(saved_tokens * total_cost / u, 6) AS weighted_savings, round(saved_tokens * total_cost / total_tokens, 6) AS blended_savings FROM (
SELECT sum(total_tokens) AS total_tokens, sum(total_cost) AS total_cost, sum(saved_tokens) AS saved_tokens, avg(savings_pct) FILTER (commands IS NOT NULL) AS p, sum({WEIGHTED}) AS u FROM econ_week_v)""")
def agg_econ_totals(spark: SparkSession, sf: str) -> DataFrame:
    s = e.period_sums(by_week(spark, sf))
    return six(s.select("total_tokens", "total_cost", "saved_tokens", "avg_savings_pct", "weighted_savings", "blended_savings"))
