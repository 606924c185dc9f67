"""Streaming jobs over the command feed. Each takes a streaming DataFrame and returns one, or a started query for sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from thriftline.functions.commands import ENV_PREFIX, base_command, words
from thriftline.functions.errors import error_class, is_command_error, is_cycle_error
from thriftline.functions.numbers import saved_tokens, share_pct
from thriftline.operators.corrections import MIN_CONFIDENCE, MIN_SIMILARITY, WINDOW, WORKED_BONUS
from thriftline.session import shared_path

#: How long rows may be late, and how long they are kept.
LATENESS, RETENTION_DAYS = "2 days", 90


def arguments(w: Column) -> Column:
    """The words of a command behind the first two."""
    return F.slice(w, F.lit(3), F.size(w))


def command_stream(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """New parquet files below path, a few per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str | T.StructType) -> DataFrame:
    """A whole table as a stream, be it one file or a folder of part files.

    All files go in the first trigger: part files are not in the order of time,
    and a later trigger would take rows behind the watermark for late ones.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(conf).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def with_savings(commands: DataFrame) -> DataFrame:
    """ts as a timestamp, saved tokens and percentage, and the date that files are partitioned by."""
    c = commands.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("saved_tokens", saved_tokens(F.col("input_tokens"), F.col("output_tokens")))
    return c.withColumn("savings_pct", share_pct(F.col("saved_tokens"), F.col("input_tokens"))).withColumn("day", F.to_date("ts"))


def ingest(commands: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet files by day until no input is left. Files and offsets are committed together, so a restart neither loses nor repeats rows."""
    return with_savings(commands).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def table_in_shared(df: DataFrame, name: str) -> str:
    df.write.parquet(path := shared_path(df.sparkSession, name))
    return path


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is, into a table in the shared folder, and read that."""
    at = shared_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def without_repeats(commands: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each key within the lateness; later ones go. State is dropped behind the watermark."""
    return commands.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])


def rollup(commands: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Savings per window (tumbling, or sliding with slide), emitted once the watermark has passed it."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    r = commands.withWatermark("ts", LATENESS).groupBy(w.alias("w")).agg(F.count("*").alias("commands"), F.sum("input_tokens").alias("input_tokens"), F.sum("saved_tokens").alias("saved_tokens"))
    return r.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commands", "input_tokens", "saved_tokens", share_pct(F.col("saved_tokens"), F.col("input_tokens")).alias("savings_pct"))


def matching_lines(lines: DataFrame) -> DataFrame:
    """Lines (output_id, line) of a test run that are worth showing: results and failures, no passing tests."""
    line = F.col("line")
    passing = line.startswith("test ") & line.endswith("... ok")
    return lines.filter(~passing & (line.contains("FAILED") | line.contains("error") | line.startswith("test result") | (F.trim(line) == "") | ~line.startswith("test ")))


def expired_days(spark: SparkSession, path: str, as_of: str, days: int = RETENTION_DAYS) -> list[str]:
    """The day partitions of an ingested table that retention lets go, from the names of its folders; no row is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs, least = at.getFileSystem(conf), date.fromisoformat(as_of[:10]) - timedelta(days=days)
    found = [f.getPath().getName().removeprefix("day=") for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith("day=")] if fs.exists(at) else []
    return sorted(d for d in found if re.fullmatch(r"\d{4}-\d\d-\d\d", d) and date.fromisoformat(d) < least)


def maintained(commands: DataFrame, path: str, checkpoint: str, as_of: str, days: int = RETENTION_DAYS) -> StreamingQuery:
    """Ingest until no input is left, and after each batch drop the day partitions that are past retention.

    A batch has partitions of its own, which it overwrites if it runs again,
    and dropping a folder twice changes nothing: a restart at any point,
    between the drop and the commit too, loses and repeats no row.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for day in expired_days(spark, path, as_of, days):
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
            at.getFileSystem(conf).delete(at, True)

    return with_savings(commands).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CORRECTION = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("sequence_index", T.LongType()), T.StructField("wrong_command", T.StringType()), T.StructField("right_command", T.StringType()), T.StructField("error_class", T.StringType()), T.StructField("confidence", T.DoubleType())])
OPEN = T.StructType([T.StructField("open", T.ArrayType(T.StructType([T.StructField("sequence_index", T.LongType()), T.StructField("command", T.StringType()), T.StructField("base", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("error_class", T.StringType()), T.StructField("left", T.IntegerType())])))])


def corrections(calls: DataFrame) -> DataFrame:
    """Error-then-fix pairs as calls (session_id, sequence_index, command, is_error, output_content) arrive in order.

    A session's state is its failed calls that may still be corrected, three at
    most. What a call is, is decided by the batch job's expressions before.
    """
    rows = calls.filter("output_content is not null").select(
        "session_id", "sequence_index", "command", base_command(F.col("command")).alias("base"), F.array_distinct(arguments(words(F.regexp_replace(F.trim("command"), ENV_PREFIX, "")))).alias("args"),
        is_command_error(F.col("is_error"), F.col("output_content")).alias("failed"), is_cycle_error(F.col("output_content")).alias("cycle"), error_class(F.col("output_content")).alias("error_class"),
    )

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = [dict(zip(("sequence_index", "command", "base", "args", "error_class", "left"), x)) for x in (state.get[0] if state.exists else [])]
        found = []
        for row in pd.concat(list(batches)).sort_values("sequence_index").itertuples():
            args = set(row.args)
            still = []
            for p in pending:
                both = args | set(p["args"])
                sim = 0.0 if row.base != p["base"] else 0.5 + 0.5 * len(args & set(p["args"])) / len(both) if both else 1.0
                confidence = sim if row.failed else min(sim + WORKED_BONUS, 1.0)
                if sim >= MIN_SIMILARITY and not 0.9 < sim < 1 and row.command != p["command"] and confidence >= MIN_CONFIDENCE:
                    found.append((key[0], p["sequence_index"], p["command"], row.command, p["error_class"], confidence))
                elif p["left"] > 1:
                    still.append(p | {"left": p["left"] - 1})
            pending = still
            if row.failed and not row.cycle:
                pending.append({"sequence_index": row.sequence_index, "command": row.command, "base": row.base, "args": list(row.args), "error_class": row.error_class, "left": WINDOW})
        state.update(([tuple([p["sequence_index"], p["command"], p["base"], list(p["args"]), p["error_class"], p["left"]]) for p in pending],))
        if found:
            yield pd.DataFrame(found, columns=CORRECTION.fieldNames())

    return rows.groupBy("session_id").applyInPandasWithState(follow, CORRECTION, OPEN, "append", "NoTimeout")
