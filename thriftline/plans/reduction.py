"""Queries of output and log reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import text as t
from thriftline.functions.numbers import estimate_tokens
from thriftline.operators import reduction as op
from thriftline.plans.corrections import quoted
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d

NORMAL = "line"
for _pattern, _instead in t.LOG_PARTS:
    NORMAL = f"regexp_replace({NORMAL}, {quoted(_pattern)}, {quoted(_instead)}, 'g')"
SEVERITY = "CASE WHEN regexp_matches(lower(line), 'error|fatal|panic') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn' WHEN contains(lower(line), 'info') THEN 'info' END"
KIND = "CASE WHEN regexp_matches(lower(line), 'error|failed|fatal') THEN 'error' WHEN contains(lower(line), 'warn') AND NOT contains(lower(line), 'error') THEN 'warning' END"
view("log_patterns_v", f"SELECT output_id, severity, pattern, count(*) AS n, arg_min(line, line_no) AS example FROM (SELECT *, {SEVERITY} AS severity, trim({NORMAL}) AS pattern FROM output_lines_v) WHERE severity IS NOT NULL GROUP BY 1, 2, 3")
KEEP, DROP = "fatal", "(?i)info|^\\s"
KEPT = f"(regexp_matches(line, {quoted(KEEP)}) OR NOT regexp_matches(line, {quoted(DROP)}))"


@query(f"SELECT output_id, line_no, trim({NORMAL}) AS pattern, {SEVERITY} AS severity, {KIND} AS kind, regexp_matches(line, {quoted(t.ERROR_LINE)}) AS is_error FROM output_lines_v")
def fn_log_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """fn_log_normalize, fn_log_severity, fn_line_kind and fn_error_pattern on every line."""
    line = F.col("line")
    return d.output_lines(spark, sf).select("output_id", "line_no", t.normalised_log_line(line).alias("pattern"), t.log_severity(line).alias("severity"), t.line_kind(line).alias("kind"), t.is_error_line(line).alias("is_error"))


@query("SELECT * FROM log_patterns_v")
def agg_log_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return op.log_patterns(d.output_lines(spark, sf))


@query("""SELECT output_id, severity, pattern, n, CASE WHEN length(example) <= 100 THEN example ELSE substr(example, 1, 97) || '...' END AS example, rank FROM (
SELECT *, row_number() OVER (PARTITION BY output_id, severity ORDER BY n DESC, pattern)::INT AS rank FROM log_patterns_v WHERE severity IN ('error', 'warn')) WHERE rank <= CASE WHEN severity = 'error' THEN 10 ELSE 5 END""")
def win_topn_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return op.top_log_patterns(d.output_lines(spark, sf))


@query("SELECT output_id, " + ", ".join(f"coalesce(sum(n) FILTER (severity = '{s}'), 0)::BIGINT AS {s}_lines, count(*) FILTER (severity = '{s}') AS {s}_patterns" for s in ("error", "warn", "info")) + " FROM log_patterns_v GROUP BY 1")
def agg_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.log_summary(d.output_lines(spark, sf))


@query(f"""SELECT *, CASE WHEN tokens <= 500 OR lines <= 5 THEN 'passthrough' WHEN tokens <= 2000 THEN 'light' ELSE 'structured' END AS level, CASE WHEN tokens >= 4000 THEN 'summarise' ELSE 'filter' END AS action FROM (
SELECT output_id, count(*) AS lines, ceil((sum(length(line) + 1) - 1) / 4)::BIGINT AS tokens, count(*) FILTER (k = 'error') AS error_lines, count(*) FILTER (k = 'warning') AS warning_lines FROM (SELECT *, {KIND} AS k FROM output_lines_v) GROUP BY 1)""")
def agg_output_summary(spark: SparkSession, sf: str) -> DataFrame:
    """agg_output_summary, fn_adaptive_level and fn_output_action."""
    return op.output_summary(d.output_lines(spark, sf))


@query(f"SELECT output_id, line_no, line FROM output_lines_v WHERE {KEPT}")
def flt_keep_drop(spark: SparkSession, sf: str) -> DataFrame:
    return op.filtered(d.output_lines(spark, sf), KEEP, DROP).select("output_id", "line_no", "line")


@query(f"SELECT output_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY output_id ORDER BY line_no) AS l FROM output_lines_v WHERE {KEPT}) WHERE l IS NULL OR l <> line OR regexp_matches(line, {quoted(KEEP)})")
def win_consecutive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op.without_repeats(d.output_lines(spark, sf), KEEP, DROP).select("output_id", "line_no", "line")


@query("SELECT output_id, line, min(line_no) AS line_no FROM output_lines_v GROUP BY 1, 2")
def win_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_occurrences(d.output_lines(spark, sf)).select("output_id", "line", "line_no")


@query(f"SELECT output_id, line_no, line FROM (SELECT *, max(line_no) OVER (PARTITION BY output_id) AS e FROM output_lines_v) WHERE line_no > e - 5 OR regexp_matches(line, {quoted(KEEP)})")
def win_tail_keep(spark: SparkSession, sf: str) -> DataFrame:
    return op.tail(d.output_lines(spark, sf), 5, KEEP).select("output_id", "line_no", "line")


@query("SELECT output_id, line_no, CASE WHEN length(line) <= 120 THEN line ELSE substr(line, 1, 117) || '...' END AS line FROM output_lines_v WHERE line_no < 10")
def win_head_lines(spark: SparkSession, sf: str) -> DataFrame:
    return op.head(d.output_lines(spark, sf), 10).select("output_id", "line_no", "line")


@query(f"""SELECT output_id, line_no, line FROM (SELECT *, sum(ends) OVER (PARTITION BY output_id, block ORDER BY line_no) AS over_ FROM (
SELECT *, CASE WHEN blank AND sum(blank::INT) OVER (PARTITION BY output_id, block, run ORDER BY line_no) >= 2 THEN 1 WHEN NOT blank AND NOT is_error AND NOT regexp_matches(line, '^[ \\t]') THEN 1 ELSE 0 END AS ends FROM (
SELECT *, sum((NOT blank)::INT) OVER (PARTITION BY output_id, block ORDER BY line_no) AS run FROM (
SELECT *, sum(is_error::INT) OVER (PARTITION BY output_id ORDER BY line_no) AS block FROM (
SELECT *, regexp_matches(line, {quoted(t.ERROR_LINE)}) AS is_error, trim(line) = '' AS blank FROM output_lines_v)) WHERE block > 0))) WHERE over_ = 0""")
def win_error_block(spark: SparkSession, sf: str) -> DataFrame:
    return op.error_blocks(d.output_lines(spark, sf)).select("output_id", "line_no", "line")


@query("""SELECT output_id, line_no, CASE WHEN NOT hit AND n = 2 THEN greatest(size - 2, 0) ELSE 0 END AS skipped FROM (
SELECT *, row_number() OVER (PARTITION BY output_id, run ORDER BY hit, line_no) AS n, count(*) FILTER (NOT hit) OVER (PARTITION BY output_id, run) AS size FROM (
SELECT *, sum(hit::INT) OVER (PARTITION BY output_id ORDER BY line_no) AS run FROM (SELECT *, regexp_matches(line, 'ERROR|fatal') AS hit FROM output_lines_v))) WHERE hit OR n <= 2""")
def win_context_run(spark: SparkSession, sf: str) -> DataFrame:
    return op.runs_collapsed(d.output_lines(spark, sf), "ERROR|fatal", 2).select("output_id", "line_no", "skipped")


@query("WITH w AS (SELECT output_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM outputs_v) SELECT * FROM w UNION ALL SELECT NULL, sum(lines)::BIGINT, sum(words)::BIGINT, sum(bytes)::BIGINT, sum(chars)::BIGINT FROM w")
def agg_wc(spark: SparkSession, sf: str) -> DataFrame:
    return op.with_total(op.word_counts(d.outputs(spark, sf)))


@query("""SELECT pair_id, line_no, unnest(c).change AS change, unnest(c).line AS line FROM (
SELECT coalesce(a.output_id, b.output_id) AS pair_id, coalesce(a.line_no, b.line_no) AS line_no,
  list_distinct(string_split(a.line, '')) AS x, list_distinct(string_split(b.line, '')) AS y, len(list_distinct(list_concat(x, y))) AS u,
  CASE WHEN a.line IS NULL THEN [{'change': 'added', 'line': b.line}] WHEN b.line IS NULL THEN [{'change': 'removed', 'line': a.line}]
    WHEN u = 0 OR a.line = '' AND b.line = '' OR (a.line <> '' AND b.line <> '' AND len(list_intersect(x, y)) / u > 0.5) THEN [{'change': 'modified', 'line': b.line}] ELSE [{'change': 'removed', 'line': a.line}, {'change': 'added', 'line': b.line}] END AS c
FROM output_lines_v a FULL JOIN (SELECT output_id - 1 AS output_id, line_no, line FROM output_lines_v WHERE output_id > 0) b ON a.output_id = b.output_id AND a.line_no = b.line_no
WHERE a.line IS DISTINCT FROM b.line)""")
def join_line_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each output against the next one."""
    rows = d.output_lines(spark, sf).select(F.col("output_id").alias("pair_id"), "line_no", "line")
    return op.line_diff(rows, rows.filter("pair_id > 0").withColumn("pair_id", F.col("pair_id") - 1))


#: What the query adds to each page: noise, code with the same noise in it, and a comment.
PAGE_NOISE, PAGE_CODE, PAGE_TAIL = "\n\n\n\n---\n![x](y)\n[![b](c)](d)\n", "```sh\n<!-- a -->\n\n\n\n---\n``` \n", "<!-- gone -->tail \n"


def cleaned_sql(text: str) -> str:
    for p in ("(?s)<!--.*?-->", *(rf"(?m)^\s*{x}\s*$" for x in (r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", r"!\[[^\]]*\]\([^)]*\)", r"(?:---+|\*\*\*+|___+)"))):
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT output_id, strlen(b) AS bytes, md5(b) AS body_md5 FROM (SELECT page_id AS output_id, regexp_replace({cleaned_sql(f"html || '{PAGE_NOISE}'")} || '{PAGE_CODE}' || {cleaned_sql(f"'{PAGE_TAIL}'")}, '^\\s+|\\s+$', '', 'g') AS b FROM pages)")
def fn_markdown_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with noise, code and a comment at its end."""
    text = F.concat("html", F.lit(PAGE_NOISE), F.lit(PAGE_CODE), F.lit(PAGE_TAIL))
    cleaned = op.markdown_clean(d.read(spark, sf, "pages").select(F.col("page_id").alias("output_id"), text.alias("text")))
    return cleaned.select("output_id", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("body_md5"))


@query(f"SELECT event_id, CASE WHEN regexp_matches(lower(k), '{t.SENSITIVE}') THEN CASE WHEN length(v) > 4 THEN substr(v, 1, 2) || '****' || substr(v, -2) ELSE '****' END ELSE v END AS shown FROM (SELECT event_id, ['PATH', 'API_TOKEN', 'DB_PASSWORD', 'HOME'][event_id % 4 + 1] AS k, props || event_id AS v FROM events)")
def fn_mask_secret(spark: SparkSession, sf: str) -> DataFrame:
    e = d.read(spark, sf, "events")
    key = F.element_at(F.array(F.lit("PATH"), F.lit("API_TOKEN"), F.lit("DB_PASSWORD"), F.lit("HOME")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", t.masked(key, F.concat("props", F.col("event_id").cast("string"))).alias("shown"))


@query("SELECT output_id, ceil(length(text) / 4)::BIGINT AS tokens, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS shown FROM outputs_v")
def fn_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return d.outputs(spark, sf).select("output_id", estimate_tokens(F.col("text")).alias("tokens"), t.truncated(F.col("text"), 80).alias("shown"))
