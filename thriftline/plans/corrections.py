"""Queries of correction mining and of the expressions it is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import commands as c
from thriftline.functions import errors as x
from thriftline.operators import corrections as op
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_sql(col: str, texts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(t)})" for t in texts) + ")"


STRIPPED = f"regexp_replace(trim({{}}), {quoted(c.ENV_PREFIX)}, '')"
WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
ERROR = f"(is_error AND NOT regexp_matches(output_content, {quoted('(?i)' + x.REJECTED)}) AND {contains_sql('lower(output_content)', x.ERROR_WORDS)})"
CLASS = "CASE " + " ".join(f"WHEN regexp_matches(output_content, {quoted('(?i)' + p)}) THEN {quoted(n)}" for n, p in x.ERROR_CLASSES) + " ELSE 'General Error' END"
CYCLE = f"""({contains_sql("output_content", x.CYCLE_TEXTS)} OR (contains(output_content, 'FAILED ') AND contains(output_content, '::'))
  OR ({contains_sql("output_content", ("FAIL ", "Tests failed:"))} AND {contains_sql("output_content", (".test.", ".spec."))}) OR (contains(output_content, 'FAIL' || chr(9)) AND contains(output_content, '---')))"""


def similarity_sql(a: str, b: str) -> str:
    """Of word lists behind prefixes."""
    x_, y_ = f"list_distinct({a}[3:])", f"list_distinct({b}[3:])"
    union = f"len(list_distinct(list_concat({x_}, {y_})))"
    return f"CASE WHEN array_to_string({a}[1:2], ' ') <> array_to_string({b}[1:2], ' ') THEN 0.0::DOUBLE WHEN {union} = 0 THEN 1.0 ELSE 0.5 + 0.5 * len(list_intersect({x_}, {y_})) / {union} END"


view("calls_w", f"SELECT *, {WORDS.format(STRIPPED.format('command'))} AS w, {WORDS.format('command')} AS aw, {ERROR} AS failed, {CYCLE} AS cycle, {CLASS} AS error_class FROM tool_calls_v WHERE output_content IS NOT NULL")
view("corrections_v", f"""
SELECT session_id, sequence_index, command AS wrong_command, nxt.command AS right_command, substr(output_content, 1, 500) AS error_output, error_class, confidence, w, aw, nxt.aw AS naw FROM (
SELECT *, row_number() OVER (PARTITION BY session_id, sequence_index ORDER BY step) AS n FROM (
SELECT *, CASE WHEN nxt.failed THEN sim ELSE least(sim + 0.2, 1.0) END AS confidence FROM (
SELECT *, {similarity_sql("w", "nxt.w")} AS sim FROM (
SELECT *, unnest(later) AS nxt, generate_subscripts(later, 1) AS step FROM (
SELECT *, [lead({{'command': command, 'failed': failed, 'w': w, 'aw': aw}}, 1) OVER o, lead({{'command': command, 'failed': failed, 'w': w, 'aw': aw}}, 2) OVER o, lead({{'command': command, 'failed': failed, 'w': w, 'aw': aw}}, 3) OVER o] AS later
FROM calls_w WINDOW o AS (PARTITION BY session_id ORDER BY sequence_index)) WHERE failed AND NOT cycle) WHERE nxt IS NOT NULL)
WHERE sim >= 0.5 AND command <> nxt.command AND NOT (sim > 0.9 AND sim < 1)) WHERE confidence >= 0.6) WHERE n = 1
""")
DIFF = """CASE WHEN len(gone) > 0 AND len(new) > 0 THEN gone[1] || ' → ' || new[1] WHEN len(gone) > 0 THEN 'removed ' || gone[1] WHEN len(new) > 0 THEN 'added ' || new[1] ELSE 'unknown' END"""
view("rules_v", f"""
SELECT base_command, error_class, diff_token, count(*) AS occurrences, min(o).w AS wrong_pattern, min(o).r AS right_pattern, min(o).e AS example_error FROM (
SELECT *, {DIFF} AS diff_token, {{'c': -confidence, 'w': wrong_command, 'r': right_command, 'e': error_output}} AS o FROM (
SELECT *, array_to_string(w[1:2], ' ') AS base_command, list_filter(aw, lambda x: NOT list_contains(naw, x)) AS gone, list_filter(naw, lambda x: NOT list_contains(aw, x)) AS new FROM corrections_v)) GROUP BY 1, 2, 3
""")


@query(f"SELECT session_id, sequence_index, coalesce({ERROR}, false) AS failed, {CLASS} AS error_class, {CYCLE} AS cycle FROM tool_calls_v WHERE output_content IS NOT NULL")
def fn_errors(spark: SparkSession, sf: str) -> DataFrame:
    """fn_is_command_error, fn_error_class and fn_is_tdd_error on every call."""
    out = F.col("output_content")
    return d.tool_calls(spark, sf).filter(out.isNotNull()).select("session_id", "sequence_index", x.is_command_error(F.col("is_error"), out).alias("failed"), x.error_class(out).alias("error_class"), x.is_cycle_error(out).alias("cycle"))


@query(f"""SELECT a.session_id, a.sequence_index, array_to_string(a.w[1:2], ' ') AS base, {similarity_sql("a.w", "b.w")} AS similarity
FROM calls_w a JOIN calls_w b ON a.session_id = b.session_id AND a.sequence_index + 1 = b.sequence_index""")
def fn_command_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """fn_base_command_learn and fn_command_similarity on each two calls in a row."""
    calls = d.tool_calls(spark, sf).filter("output_content is not null").select("session_id", "sequence_index", "command")
    after = calls.select("session_id", (F.col("sequence_index") - 1).alias("sequence_index"), F.col("command").alias("next"))
    return calls.join(after, ["session_id", "sequence_index"]).select("session_id", "sequence_index", c.base_command(F.col("command")).alias("base"), c.tokens_similarity(F.col("command"), F.col("next")).alias("similarity"))


@query("SELECT session_id, sequence_index, wrong_command, right_command, error_output, error_class, confidence FROM corrections_v")
def win_first_correction(spark: SparkSession, sf: str) -> DataFrame:
    return op.corrections(d.tool_calls(spark, sf))


@query("SELECT * FROM rules_v")
def agg_correction_rules(spark: SparkSession, sf: str) -> DataFrame:
    return op.rules(op.corrections(d.tool_calls(spark, sf)))


@query("SELECT * FROM rules_v WHERE occurrences >= 3")
def flt_min_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return op.rules(op.corrections(d.tool_calls(spark, sf)), min_occurrences=3)


@query("SELECT c.session_id, c.sequence_index, c.command, r.corrected FROM tool_calls_v c LEFT JOIN (SELECT trim(wrong_pattern) AS wrong, min(right_pattern) AS corrected FROM rules_v GROUP BY 1) r ON trim(c.command) = r.wrong")
def join_apply_correction(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.tool_calls(spark, sf)
    learned = op.rules(op.corrections(calls)).select(F.col("wrong_pattern").alias("wrong"), F.col("right_pattern").alias("right"))
    return op.apply_rules(calls.select("session_id", "sequence_index", "command"), learned)


@query("SELECT base_command, list(wrong_pattern || ' => ' || right_pattern ORDER BY occurrences DESC, wrong_pattern, right_pattern) AS rules FROM rules_v GROUP BY 1")
def sink_rules_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return op.rules_by_base(op.rules(op.corrections(d.tool_calls(spark, sf))))
