"""Queries of the last expressions, rules and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import text as t
from thriftline.operators import corrections
from thriftline.operators import extraction as x
from thriftline.operators import telemetry
from thriftline.plans.registry import query
from thriftline.sources import derived as d

col, lit = F.col, F.lit


@query("""SELECT output_id, CASE WHEN contains(command, 'test') OR contains(l, 'passed') AND contains(l, 'failed') THEN 'tests' WHEN contains(command, 'build') OR contains(command, 'compile') OR contains(l, 'compiling') THEN 'build'
WHEN contains(l, 'error:') OR contains(l, 'warn:') OR contains(l, '[info]') THEN 'log' WHEN regexp_matches(text, '^\\s*[{\\[]') THEN 'json' WHEN len(list_filter(ls, lambda x: strlen(x) >= 200 OR contains(x, chr(9)) OR len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) < 10)) = 0 THEN 'list' ELSE 'generic' END AS output_type FROM (SELECT *, lower(text) AS l, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS ls FROM (SELECT *, string_split_regex(text, '\\r?\\n') AS a FROM outputs_v))""")
def fn_output_type(spark: SparkSession, sf: str) -> DataFrame:
    return d.outputs(spark, sf).select("output_id", t.output_type(col("command"), col("text")).alias("output_type"))


@query("SELECT wrong, right_ AS \"right\" FROM (SELECT trim(wrong_pattern) AS wrong, right_pattern AS right_ FROM rules_v)")
def src_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Learned corrections, written as JSON lines and read back by their schema."""
    rules = corrections.rules(corrections.corrections(d.tool_calls(spark, sf)))
    lines = rules.select(F.to_json(F.struct(F.trim("wrong_pattern").alias("wrong"), col("right_pattern").alias("right"))).alias("line"))
    return lines.select(F.from_json("line", "wrong string, right string").alias("r")).select("r.*")
