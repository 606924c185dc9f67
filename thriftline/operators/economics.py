"""Spend beside savings: what the saved tokens of a period were worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions.numbers import share_pct

#: Price of output, cache writes and cache reads in units of an input token.
OUTPUT_WEIGHT, CACHE_WRITE_WEIGHT, CACHE_READ_WEIGHT = 5.0, 1.25, 0.1
SPENT = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", "total_cost")
SAVED = ("commands", "saved_tokens", "tracked_input", "tracked_output")


def usage_by(usage: DataFrame, key: Column, name: str) -> DataFrame:
    return usage.groupBy(key.alias(name)).agg(*[F.sum(c).alias(c) for c in SPENT])


def savings_by(commands: DataFrame, key: Column, name: str) -> DataFrame:
    return commands.groupBy(key.alias(name)).agg(
        F.count("*").alias("commands"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("input_tokens").alias("tracked_input"), F.sum("output_tokens").alias("tracked_output")
    )


def merged(spent: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """A row per period of either side; what a side lacks stays null. Both sides are aggregates, so the join is small."""
    return spent.join(saved, key, "full_outer").withColumn("savings_pct", share_pct(F.col("saved_tokens"), F.col("tracked_input"))).withColumn(
        "savings_share_pct", share_pct(F.col("saved_tokens"), F.col("saved_tokens") + F.col("tracked_input") + F.col("tracked_output"))
    )


def weighted(p: DataFrame) -> DataFrame:
    """Cost of a weighted token and what the saved ones would have cost; null unless both sides are there."""
    units = F.col("input_tokens") + OUTPUT_WEIGHT * F.col("output_tokens") + CACHE_WRITE_WEIGHT * F.col("cache_creation_tokens") + CACHE_READ_WEIGHT * F.col("cache_read_tokens")
    p = p.withColumn("weighted_units", units)
    cpt = F.when(F.col("weighted_units") > 0, F.col("total_cost") / F.col("weighted_units"))
    p = p.withColumn("weighted_cpt", F.when(F.col("saved_tokens").isNotNull(), cpt))
    return p.withColumn("weighted_savings", F.col("saved_tokens") * F.col("weighted_cpt"))


def dual(p: DataFrame) -> DataFrame:
    """Blended cost over all tokens and active cost over input and output, with the savings at either."""
    active = F.col("input_tokens") + F.col("output_tokens")
    p = p.withColumn("blended_cpt", F.when(F.col("total_tokens") > 0, F.col("total_cost") / F.col("total_tokens"))).withColumn("active_cpt", F.when(active > 0, F.col("total_cost") / active))
    return p.withColumn("blended_savings", F.col("saved_tokens") * F.col("blended_cpt")).withColumn("active_savings", F.col("saved_tokens") * F.col("active_cpt"))


def period_sums(p: DataFrame) -> DataFrame:
    """One row: sums of all columns, the plain mean of the periods' percentages, and costs anew from the sums."""
    sums = p.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*SPENT, *SAVED)], F.coalesce(F.avg(F.when(F.col("commands").isNotNull(), F.col("savings_pct"))), F.lit(0.0)).alias("avg_savings_pct"))
    return dual(weighted(sums))
