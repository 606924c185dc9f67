"""Mining of error-then-fix patterns in sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions import commands as c
from thriftline.functions.errors import error_class, is_command_error, is_cycle_error

#: How many calls a fix may come later, least confidence and similarity, bonus of a fix that worked, kept error text.
WINDOW, MIN_CONFIDENCE, MIN_SIMILARITY, WORKED_BONUS, ERROR_CHARS = 3, 0.6, 0.5, 0.2, 500


def corrections(calls: DataFrame) -> DataFrame:
    """A row per failed call that one of the session's next calls corrects; the first that qualifies counts.

    calls has session_id, sequence_index, command, is_error, output_content;
    calls without output are left out first. One sort per session, no join.
    """
    order = Window.partitionBy("session_id").orderBy("sequence_index")
    rows = calls.filter("output_content is not null").withColumn("failed", is_command_error(F.col("is_error"), F.col("output_content")))
    later = F.array(*[F.lead(F.struct("command", "failed"), i).over(order) for i in range(1, WINDOW + 1)])
    rows = rows.withColumn("later", later).filter(F.col("failed") & ~is_cycle_error(F.col("output_content")))
    rows = rows.select("*", F.posexplode("later").alias("step", "next")).filter("next is not null")
    similarity = c.tokens_similarity(F.col("command"), F.col("next.command"))
    rows = rows.withColumn("similarity", similarity).filter((F.col("similarity") >= MIN_SIMILARITY) & (F.col("command") != F.col("next.command")))
    rows = rows.filter(~((F.col("similarity") > 0.9) & (F.col("similarity") < 1.0)))
    confidence = F.when(F.col("next.failed"), F.col("similarity")).otherwise(F.least(F.col("similarity") + WORKED_BONUS, F.lit(1.0)))
    rows = rows.withColumn("confidence", confidence).filter(F.col("confidence") >= MIN_CONFIDENCE)
    first = rows.groupBy("session_id", "sequence_index").agg(F.min(F.struct("step", "command", F.col("next.command").alias("right"), "confidence", "output_content")).alias("m"))
    return first.select(
        "session_id", "sequence_index", F.col("m.command").alias("wrong_command"), F.col("m.right").alias("right_command"),
        F.substring("m.output_content", 1, ERROR_CHARS).alias("error_output"), error_class(F.col("m.output_content")).alias("error_class"), F.col("m.confidence").alias("confidence"),
    )


def rules(found: DataFrame, min_confidence: float = 0.0, min_occurrences: int = 1) -> DataFrame:
    """Corrections by base command, error class and changed token, with the example of most confidence (ties: smallest)."""
    keys = found.filter(F.col("confidence") >= min_confidence).select("*", c.base_command(F.col("wrong_command")).alias("base_command"), c.changed_token(F.col("wrong_command"), F.col("right_command")).alias("diff_token"))
    best = F.min(F.struct((-F.col("confidence")).alias("order"), "wrong_command", "right_command", "error_output"))
    g = keys.groupBy("base_command", "error_class", "diff_token").agg(F.count("*").alias("occurrences"), best.alias("b")).filter(F.col("occurrences") >= min_occurrences)
    return g.select("base_command", "error_class", "diff_token", "occurrences", F.col("b.wrong_command").alias("wrong_pattern"), F.col("b.right_command").alias("right_pattern"), F.col("b.error_output").alias("example_error"))


def apply_rules(commands: DataFrame, learned: DataFrame, max_rules: int = 100_000) -> DataFrame:
    """commands with corrected: the right command where the trimmed command is a wrong one. learned (wrong, right): the smallest right of a wrong one counts."""
    one = learned.groupBy(F.trim("wrong").alias("_wrong")).agg(F.min("right").alias("corrected"))
    one = F.broadcast(one) if learned.limit(max_rules + 1).count() <= max_rules else one
    return commands.join(one, F.trim("command") == F.col("_wrong"), "left").drop("_wrong")


def rules_by_base(r: DataFrame) -> DataFrame:
    """Rules gathered by base command, for a report: a row each, with its rules by occurrences."""
    return r.groupBy("base_command").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "wrong_pattern", "right_pattern"))), lambda x: F.concat(x["wrong_pattern"], F.lit(" => "), x["right_pattern"])).alias("rules"))
