"""Queries of registered filters and parsers over captured outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.operators import extraction as x
from thriftline.operators import filters as op
from thriftline.operators import trees
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d


def first_lines(text: str) -> str:
    return "\n".join(text.split("\n")[:3])


def half(text: str) -> tuple[str, str]:
    return text[: len(text) // 2], op.DEGRADED


def fails_on_one_in_seven(text: str) -> str:
    if len(text) % 7 == 0:
        raise ValueError(f"{len(text)} characters")
    return text[:400]


def registry() -> op.Filters:
    return op.Filters().register("tests", "test$", first_lines).register("builds", "^npm", half).register("logs", "logs?$", fails_on_one_in_seven)


view("filtered_v", """SELECT *, CASE tool WHEN 'tests' THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) WHEN 'builds' THEN left(text, length(text) // 2) WHEN 'logs' THEN CASE WHEN length(text) % 7 = 0 THEN text ELSE left(text, 400) END ELSE text END AS output,
  CASE WHEN tool IS NULL OR text IS NULL OR tool = 'logs' AND length(text) % 7 = 0 THEN 'passthrough' WHEN tool = 'builds' THEN 'degraded' ELSE 'full' END AS quality, coalesce(tool = 'logs' AND length(text) % 7 = 0, false) AS failed
FROM (SELECT *, CASE WHEN command LIKE '%test' THEN 'tests' WHEN command LIKE 'npm%' THEN 'builds' WHEN regexp_matches(command, 'logs?$') THEN 'logs' END AS tool FROM outputs_v)""")
TOKENS = "ceil(length({0}) / 4)::BIGINT"


@query(f"SELECT output_id, tool, quality, {TOKENS.format('text')} AS input_tokens, {TOKENS.format('output')} AS output_tokens, md5(output) AS output_md5 FROM filtered_v")
def udf_tool_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Three users' filters over all outputs, each with its quality and tokens."""
    r = registry().apply(d.outputs(spark, sf))
    return r.select("output_id", "tool", "result.quality", "result.input_tokens", "result.output_tokens", F.md5("result.output").alias("output_md5"))


@query(f"""SELECT output_id, CASE WHEN raw THEN 'passthrough' ELSE quality END AS quality, CASE WHEN raw THEN i ELSE o END AS output_tokens FROM (SELECT *, coalesce(trim(output, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '', false) OR coalesce(i > 0 AND (s < 0.2 OR quality = 'degraded' AND s < 0.4 OR n < 200 AND s > 0.95), false) AS raw FROM (
SELECT *, {TOKENS.format('text')} AS i, {TOKENS.format('output')} AS o, CASE WHEN i > 0 THEN 1 - o / i END AS s, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS n FROM filtered_v))""")
def udf_filter_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """The filters' results, raw where they are not worth it."""
    return op.validated(registry().apply(d.outputs(spark, sf))).select("output_id", "result.quality", "result.output_tokens")


@query(f"SELECT tool, count(*) AS outputs, count(*) FILTER (quality = 'passthrough') AS raw, count(*) FILTER (failed) AS failed, sum({TOKENS.format('text')})::BIGINT AS input_tokens, sum({TOKENS.format('output')})::BIGINT AS output_tokens FROM filtered_v GROUP BY 1")
def udf_plugin_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs by tool; a filter that raises leaves them raw and is counted."""
    return op.filter_report(registry().apply(d.outputs(spark, sf)))


PARSERS = {
    "ruff": op.Parser("diagnostics", "^ruff", x.ruff), "pylint": op.Parser("diagnostics", "^pylint", x.pylint), "pip": op.Parser("dependencies", "^pip", x.pip_packages), "pnpm": op.Parser("dependencies", "^pnpm", trees.pnpm_packages),
}


@query("SELECT CASE WHEN n % 2 = 0 THEN 'ruff' ELSE 'pylint' END AS parser, count(*) AS records, count(*) FILTER (n % 2 = 0 OR bad) AS errors FROM tool_rows_v WHERE n % 3 < 2 GROUP BY 1")
def udf_output_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics of the tools that a command names; other commands have none."""
    n = F.col("n")
    ruff = F.struct("code", "message", F.struct(F.col("line").alias("row"), F.col("col").alias("column")).alias("location"), F.col("file").alias("filename"))
    pylint = F.struct(F.when(F.col("bad"), "error").otherwise("convention").alias("type"), F.col("file").alias("path"), "line", F.col("col").alias("column"), F.col("code").alias("symbol"), F.col("code").alias("message-id"), "message")
    command = F.when(n % 3 == 2, "make").when(n % 2 == 0, "ruff check").otherwise("pylint src")
    text = F.when(n % 2 == 0, F.to_json(F.array(ruff))).otherwise(F.to_json(F.array(pylint)))
    rows = op.parsed(d._tool_rows(spark, sf).select("output_id", command.alias("command"), text.alias("text")), PARSERS, "diagnostics")
    return rows.groupBy("parser").agg(F.count("*").alias("records"), F.count_if(F.col("severity") == "error").alias("errors"))
