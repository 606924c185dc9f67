"""Filters and parsers that users register for tools, applied to captured outputs (output_id, command, text).

A filter is a Python function of one text. It runs on the executors in small
batches of rows, as texts may be long, in one pass over the outputs whatever
the number of tools; texts that no filter takes do not go there. What it raises
never fails a job: the text comes back raw, and the row says why.
A parser is a function of DataFrames, so that Spark plans it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions.numbers import estimate_tokens
from thriftline.functions.text import strip_ansi, stripped

FULL, DEGRADED, PASSTHROUGH = "full", "degraded", "passthrough"
RESULT = "struct<output:string,quality:string,error:string>"
#: Shares of tokens that a filter has to save, more for a degraded one, and from which on a short text's result is not trusted.
LEAST_SAVED, LEAST_DEGRADED, MOST_SAVED, SHORT_LINES = 0.20, 0.40, 0.95, 200


@dataclass(frozen=True)
class Filter:
    """name, the commands that it takes (a regular expression), and the function: a text gives a text, or a text and its quality; None gives the text back as it is."""

    name: str
    command: str
    run: Callable[[str], str | tuple[str, str] | None]
    strips_ansi: bool = False


class Filters:
    """Registered filters; the first one whose expression finds something in a command takes its outputs."""

    def __init__(self, filters: tuple[Filter, ...] = ()):
        self.filters = list(filters)

    def register(self, name: str, command: str, run: Callable, strips_ansi: bool = False) -> Filters:
        if any(f.name == name for f in self.filters):
            raise ValueError(f"a filter named {name!r} is registered")
        self.filters.append(Filter(name, command, run, strips_ansi))
        return self

    def tool(self, command: Column) -> Column:
        """The name of the filter that takes a command; null where none does."""
        out = F.lit(None).cast("string")
        for f in reversed(self.filters):
            out = F.when(command.rlike(f.command), f.name).otherwise(out)
        return out

    def udf(self):
        """(tool, text) to RESULT: raw and `passthrough` with the error's text where the filter raises or gives no text."""
        runs = {f.name: f.run for f in self.filters}

        def one(tool: str | None, text: str | None) -> tuple[str | None, str, str | None]:
            if text is None or tool is None:
                return text, PASSTHROUGH, None
            try:
                made = runs[tool](text)
                output, quality = made if isinstance(made, tuple) else (made, FULL)
                if output is None:
                    return text, PASSTHROUGH, None
                if not isinstance(output, str) or quality not in (FULL, DEGRADED, PASSTHROUGH):
                    raise TypeError(f"a filter gives a text and a quality, not {type(output).__name__} and {quality!r}")
                return output, quality, None
            except Exception as e:  # noqa: BLE001  a user's code may raise anything
                return text, PASSTHROUGH, f"{type(e).__name__}: {e}"

        return F.udf(one, RESULT, useArrow=False)

    def apply(self, outputs: DataFrame) -> DataFrame:
        """outputs with tool, result (output, quality, input_tokens, output_tokens) and error; what no filter takes is passed through, null stays null."""
        clean = F.lit(False)
        for f in self.filters:
            clean = clean | (F.col("_tool") == f.name) if f.strips_ansi else clean
        rows = outputs.withColumn("_tool", self.tool(F.col("command"))).withColumn("_text", F.when(F.coalesce(clean, F.lit(False)), strip_ansi(F.col("text"))).otherwise(F.col("text")))
        taken = F.col("_tool").isNotNull()  # only texts that a filter takes go to Python, the others stay where they are
        rows = rows.withColumn("_r", self.udf()("_tool", F.when(taken, F.col("_text"))))
        output = F.when(taken, F.col("_r.output")).otherwise(F.col("_text"))
        result = F.struct(output.alias("output"), F.col("_r.quality").alias("quality"), estimate_tokens(F.col("_text")).alias("input_tokens"), estimate_tokens(output).alias("output_tokens"))
        return rows.select(*outputs.columns, F.col("_tool").alias("tool"), result.alias("result"), F.col("_r.error").alias("error"))

    def register_sql(self, spark: SparkSession, name: str = "reduce_output") -> None:
        """Make the filters a SQL function of a tool's name and a text."""
        spark.udf.register(name, self.udf())


def validated(reduced: DataFrame) -> DataFrame:
    """Reduced outputs (text, result) with raw results where reducing is not worth it or not to be trusted: empty, hardly shorter, or a short text that all but vanished."""
    r = F.col("result")
    saved = 1 - r["output_tokens"] / F.nullif(r["input_tokens"], F.lit(0))
    n_lines = F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    empty = (stripped(r["output"]) == "") & (stripped("text") != "")
    poor = (r["input_tokens"] > 0) & ((saved < LEAST_SAVED) | ((r["quality"] == DEGRADED) & (saved < LEAST_DEGRADED)) | ((n_lines < SHORT_LINES) & (saved > MOST_SAVED)))
    raw = F.struct(F.col("text").alias("output"), F.lit(PASSTHROUGH).alias("quality"), estimate_tokens(F.col("text")).alias("input_tokens"), estimate_tokens(F.col("text")).alias("output_tokens"))
    return reduced.withColumn("result", F.when(F.coalesce(empty | poor, F.lit(False)), raw).otherwise(r))


def filter_report(reduced: DataFrame) -> DataFrame:
    """Per tool: outputs, how many came back raw, how many because the filter failed, and the tokens in and out."""
    return reduced.groupBy("tool").agg(
        F.count("*").alias("outputs"), F.count_if(F.col("result.quality") == PASSTHROUGH).alias("raw"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("result.input_tokens").alias("input_tokens"), F.sum("result.output_tokens").alias("output_tokens"),
    )


@dataclass(frozen=True)
class Parser:
    """kind of record (diagnostics, tests, dependencies), the commands that it takes, and the function: outputs (output_id, text) to records."""

    kind: str
    command: str
    run: Callable[[DataFrame], DataFrame]


def parsed(outputs: DataFrame, parsers: dict[str, Parser], kind: str) -> DataFrame:
    """The records of one kind of all outputs whose command a parser of that kind takes, with the parser's name as `parser`; columns that a parser lacks are null."""
    out = None
    for name, p in parsers.items():
        if p.kind == kind:
            rows = p.run(outputs.filter(F.col("command").rlike(p.command)).select("output_id", "text")).withColumn("parser", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no parser of {kind!r} is registered")
    return out
