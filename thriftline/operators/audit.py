"""The hook's audit log: lines to entries, and what they say about rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions.commands import base_command_after_env

#: Actions that a rewrite could have been.
ACTIONABLE = ("rewrite", "skip:no_match", "skip:no_binary", "skip:no_jq", "skip:old_version", "skip:jq_parse_error")


def entries(lines: DataFrame) -> DataFrame:
    """(ts, action, original_cmd, rewritten_cmd) of lines (value): fields between ` | `, a missing fourth is -, lines under three fields go."""
    f = F.split("value", r" \| ", 4)
    return lines.filter(F.size(f) >= 3).select(
        F.try_to_timestamp(F.get(f, 0), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.get(f, 1).alias("action"), F.get(f, 2).alias("original_cmd"), F.coalesce(F.get(f, 3), F.lit("-")).alias("rewritten_cmd")
    )


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def summary(e: DataFrame) -> DataFrame:
    rewrites = F.count_if(F.col("action") == "rewrite")
    t = e.agg(F.count("*").alias("total"), rewrites.alias("rewrites"), F.count_if(F.col("action").isin(*ACTIONABLE)).alias("actionable"))
    t = t.withColumn("skips", F.col("total") - F.col("rewrites")).withColumn("rewrite_pct", pct(F.col("rewrites"), F.col("total")))
    return t.withColumn("coverage_pct", F.when(F.col("actionable") == 0, 100.0).otherwise(pct(F.col("rewrites"), F.col("actionable"))))


def skip_reasons(e: DataFrame) -> DataFrame:
    reason = F.substring("action", 6, 1000)
    return e.filter(F.col("action").startswith("skip:")).groupBy(reason.alias("reason")).agg(F.count("*").alias("entries"))


def rewritten_commands(e: DataFrame) -> DataFrame:
    return e.filter(F.col("action") == "rewrite").groupBy(base_command_after_env(F.col("original_cmd")).alias("base_cmd")).agg(F.count("*").alias("entries"))
