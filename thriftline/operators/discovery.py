"""Missed savings: which commands of sessions a reducer would have known."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions import commands as c
from thriftline.sources import rules as r


def is_ignored(cmd: Column) -> Column:
    """One pattern, so that cmd, which may be a long expression, is computed once."""
    exact, prefixes = ("|".join(map(re.escape, texts)) for texts in (r.IGNORED_EXACT, r.IGNORED_PREFIXES))
    return cmd.rlike(rf"^(?:(?:{exact})?\z|{prefixes})")


def category_tokens(category: Column, subcmd: Column) -> Column:
    """Tokens of an output of unknown length."""
    out = F.lit(r.DEFAULT_TOKENS)
    for name, n in r.CATEGORY_TOKENS.items():
        out = F.when(category == name, n).otherwise(out)
    for (name, sub), n in r.SUBCOMMAND_TOKENS.items():
        out = F.when((category == name) & (subcmd == sub), n).otherwise(out)
    return out.cast("long")


#: The most frequent commands, which are joined back by broadcast: any other one has less than a HEAVY-th of the rows.
HEAVY = 4096


def once_per(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that make gives for each distinct key (a row each): its work follows the number of different keys.

    A few keys may hold any share of the rows, so the HEAVY most frequent ones
    are broadcast; the others are shuffled. Rows without a key, or whose key
    make leaves out, go.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    made = make(counts.select(key))
    heavy = F.broadcast(counts.orderBy(F.desc("_n"), key).limit(HEAVY).select(key))
    often = rows.join(F.broadcast(made.join(heavy, key, "left_semi")), key)
    return often.unionByName(rows.join(heavy, key, "left_anti").join(made.join(heavy, key, "left_anti"), key))


def split_calls(calls: DataFrame) -> DataFrame:
    """A row per part of each call's command chain: calls with part_index and part. Different commands are split once."""
    split = once_per(calls, "command", lambda known: known.withColumn("_parts", c.split_chain("command")))
    return split.select(*calls.columns, F.posexplode("_parts").alias("part_index", "part"))


KINDS = ("kind", "rule", "target", "category", "pct", "status", "subcmd", "base_cmd")


def classified(commands: DataFrame, rules: DataFrame, col: str) -> DataFrame:
    """Distinct commands (col) with KINDS: matched against the rules, a fixed small table, so it is broadcast."""
    clean = c.strip_env_prefix(F.trim(col))
    inner = c.strip_env_prefix(c.unwrap_runner(clean))
    known = commands.withColumn("ignored", is_ignored(F.trim(col)) | (clean == "") | is_ignored(inner)).withColumn("clean", inner)
    hit = known.filter(~F.col("ignored")).join(F.broadcast(rules), F.expr("clean rlike pattern"))
    best = hit.groupBy(col).agg(F.max_by(F.struct("pattern", "target", "category", "savings_pct", "subcmd_savings", "subcmd_status", "idx"), "idx").alias("r"))
    known = known.join(best, col, "left").withColumn("subcmd", F.expr("case when r is not null then nullif(regexp_extract(clean, r.pattern, if(r.pattern like '%(%', 1, 0)), '') end"))
    return known.select(
        col,
        F.when(F.col("ignored"), "ignored").when(F.col("r").isNotNull(), "supported").otherwise("unsupported").alias("kind"),
        F.col("r.idx").alias("rule"), F.col("r.target").alias("target"), F.col("r.category").alias("category"),
        F.coalesce(F.try_element_at("r.subcmd_savings", "subcmd"), "r.savings_pct").alias("pct"),
        F.when(F.col("r").isNotNull(), F.coalesce(F.try_element_at("r.subcmd_status", "subcmd"), F.lit("existing"))).alias("status"),
        "subcmd", F.when(~F.col("ignored") & F.col("r").isNull(), c.base_command_discover(F.col("clean"))).alias("base_cmd"),
    )


def classify(commands: DataFrame, rules: DataFrame, col: str = "part") -> DataFrame:
    """commands with kind (supported, unsupported, ignored), rule, target, category, pct, status, subcmd and base_cmd."""
    return once_per(commands, col, lambda known: classified(known, rules, col))


def classified_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """split_calls and classify in one: different commands are split, their different parts classified, and the calls joined once."""

    def make(known: DataFrame) -> DataFrame:
        parts = known.select("command", F.posexplode(c.split_chain("command")).alias("part_index", "part"))
        kinds = classified(parts.select("part").distinct(), rules, "part")
        told = parts.join(kinds, "part").groupBy("command").agg(F.collect_list(F.struct("part_index", "part", *KINDS)).alias("_parts"))
        return told.select("command", "_parts")

    joined = once_per(calls, "command", make)
    return joined.select(*calls.columns, F.inline("_parts"))


def with_savings(parts: DataFrame) -> DataFrame:
    """Classified parts with the tokens that each would have saved, rounded down."""
    tokens = F.coalesce(F.expr("output_len div 4"), category_tokens(F.col("category"), F.col("subcmd")))
    return parts.withColumn("saveable", F.when(F.col("kind") == "supported", F.floor(tokens * F.col("pct") / 100)).cast("long")).withColumn("shown", c.display_command(F.col("part")))


def rule_hits(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with the parts of commands that it decides, 0 where there are none."""
    hits = parts.filter("rule is not null").groupBy(F.col("rule").alias("idx")).agg(F.count("*").alias("commands"))
    return rules.join(hits, "idx", "left").na.fill(0, ["commands"])


def supported(parts: DataFrame) -> DataFrame:
    """Per target: parts, saveable tokens, the first part's percentage, and the most common display command (ties: smallest)."""
    s = parts.filter(F.col("kind") == "supported")
    shown = s.groupBy("target", "category", "shown", "status").agg(F.count("*").alias("n"), F.sum("saveable").alias("saveable"), F.min(F.struct("session_id", "sequence_index", "part_index", "pct")).alias("first"))
    best = F.min(F.struct(-F.col("n"), "shown", "status"))
    return shown.groupBy("target", "category").agg(F.sum("n").alias("commands"), F.sum("saveable").alias("saveable"), F.min("first")["pct"].alias("pct"), best["shown"].alias("command"), best["status"].alias("status"))


def unsupported(parts: DataFrame) -> DataFrame:
    """Per base command: parts and the first example."""
    u = parts.filter(F.col("kind") == "unsupported")
    return u.groupBy("base_cmd").agg(F.count("*").alias("commands"), F.min(F.struct("session_id", "sequence_index", "part_index", "shown"))["shown"].alias("example"))


def report(parts: DataFrame) -> DataFrame:
    """One row: parts of each kind, saveable tokens, and the share that a reducer already knows."""
    t = parts.agg(F.count("*").alias("commands"), F.count_if(F.col("kind") == "supported").alias("supported"), F.count_if(F.col("kind") == "unsupported").alias("unsupported"), F.coalesce(F.sum("saveable"), F.lit(0)).alias("saveable"))
    return t.withColumn("supported_pct", F.when(F.col("commands") > 0, F.col("supported") * 100.0 / F.col("commands")).otherwise(0.0))
