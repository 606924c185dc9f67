"""Queries of JSON reduction and of single expressions and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import commands as c
from thriftline.functions import json as j
from thriftline.functions import text as t
from thriftline.operators import corrections, discovery, economics, listing, telemetry
from thriftline.operators import extraction as x
from thriftline.operators import reduction as red
from thriftline.plans import economics as econ
from thriftline.plans.corrections import quoted, similarity_sql
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d
from thriftline.sources import rules as r

#: Limits of the reduction profiles.
PROFILES = {"debug": (240, 150), "balanced": (150, 75), "aggressive": (80, 40)}
col, lit = F.col, F.lit


def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON text per event: a null, a long string, a long array and a deep object."""
    n = col("n")
    doc = F.struct(
        F.when(n % 2 == 0, lit("x")).alias("maybe"), F.repeat(lit("s"), F.when(n % 4 == 0, 6000).otherwise(n % 3 * 60).cast("int")).alias("long"), F.sequence(lit(1), (n % 30 + 1).cast("int")).alias("items"),
        F.struct(F.struct(F.struct(n.alias("v")).alias("c")).alias("b")).alias("a"),
    )
    return d._tool_rows(spark, sf).select("n", F.to_json(doc, {"ignoreNullFields": "false"}).alias("text"))


view("json_v", "SELECT n, CASE WHEN n % 2 = 0 THEN '\"x\"' END AS maybe, repeat('s', CASE WHEN n % 4 = 0 THEN 6000 ELSE n % 3 * 60 END::INT) AS long, range(1, (n % 30 + 2)::BIGINT) AS items FROM tool_rows_v")
ITEMS = "array_to_string(items[1:{k}], ',') || CASE WHEN len(items) > {k} THEN ',\"{note}\"' ELSE '' END"


@query("SELECT n, '{' || coalesce('\"maybe\":' || maybe || ',', '') || '\"long\":\"' || long || '\",\"items\":[' || " + ITEMS.format(k=20, note="... (' || len(items) - 20 || ' more items)") + " || '],\"a\":{\"b\":{\"c\":{\"v\":' || n || '}}}}' AS text FROM json_v")
def fn_json_prune(spark: SparkSession, sf: str) -> DataFrame:
    return json_rows(spark, sf).select("n", j.json_prune(col("text")).alias("text"))


@query("SELECT n, CASE WHEN length(long) < 5000 THEN '{\"maybe\":' || coalesce(maybe, 'null') || ',\"long\":\"' || long || '\",\"items\":[' || array_to_string(items, ',') || '],\"a\":{\"b\":{\"c\":{\"v\":' || n || '}}}}' ELSE '{\"maybe\":' || coalesce(maybe, 'null') || ',\"long\":\"' || CASE WHEN length(long) > 100 THEN substr(long, 1, 100) || '...(' || length(long) || 'chars)' ELSE long END || '\",\"items\":[' || " + ITEMS.format(k=3, note="...+' || len(items) - 3 || ' more") + " || '],\"a\":{\"b\":{\"c\":\"{...1 keys}\"}}}' END AS text FROM json_v")
def fn_json_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return json_rows(spark, sf).select("n", j.json_truncate(col("text")).alias("text"))


@query("SELECT n, '{\"a\":{\"b\":{\"c\":{\"v\":' || n || '}}},\"items\":[' || array_to_string(items, ',') || '],\"long\":\"' || long || '\",\"maybe\":' || coalesce(maybe, 'null') || '}' AS text FROM json_v WHERE n % 5 > 0 UNION ALL SELECT n, 'no { json ' || n FROM json_v WHERE n % 5 = 0")
def fn_compact_json(spark: SparkSession, sf: str) -> DataFrame:
    """Minified with sorted keys; every fifth text is no JSON."""
    said = F.when(col("n") % 5 > 0, col("text")).otherwise(F.concat(lit(" no\n  {  json\t"), "n"))
    return json_rows(spark, sf).select("n", j.compact_json(said).alias("text"))


WHOLE_JSON = "'{\"maybe\":' || coalesce(maybe, 'null') || ',\"long\":\"' || long || '\",\"items\":[' || array_to_string(items, ',') || '],\"a\":{\"b\":{\"c\":{\"v\":' || n || '}}}}'"


@query(f"SELECT n, CASE WHEN n % 3 > 0 THEN md5({WHOLE_JSON}) END AS found_md5 FROM json_v")
def fn_json_extract_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """The object behind a banner with braces; every third text holds none."""
    banner = F.when(col("n") % 3 > 0, F.concat(lit("> run {x}\n"), "text", lit(" done"))).otherwise("no { json")
    return json_rows(spark, sf).select("n", F.md5(j.json_embedded(banner)).alias("found_md5"))


@query("SELECT n, CASE WHEN length(long) < 5000 THEN 1.0::DOUBLE ELSE 0.0 END AS kept FROM json_v")
def fn_structure_preservation(spark: SparkSession, sf: str) -> DataFrame:
    return json_rows(spark, sf).select("n", j.structure_preserved(col("text"), j.json_truncate(col("text"))).alias("kept"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || chr(10) || chr(10) || '[truncated] (' || length(text) || ' chars → 500 chars)' END AS shown FROM documents")
def fn_truncate_marker(spark: SparkSession, sf: str) -> DataFrame:
    text = col("text")
    note = F.concat(F.substring(text, 1, 500), lit("\n\n[truncated] ("), F.length(text), lit(" chars → 500 chars)"))
    return d.read(spark, sf, "documents").select("doc_id", F.when(F.length(text) <= 500, text).otherwise(note).alias("shown"))


@query("SELECT output_id, line_no, CASE WHEN regexp_matches(lower(line), 'error|fatal') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn' WHEN contains(lower(line), 'info') THEN 'info' END AS severity FROM output_lines_v")
def fn_quick_severity(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("line")
    return d.output_lines(spark, sf).select("output_id", "line_no", F.when(low.rlike("error|fatal"), "error").when(low.contains("warn"), "warn").when(low.contains("info"), "info").alias("severity"))


@query("SELECT output_id, line_no, line FROM output_lines_v")
def fn_strip_ansi(spark: SparkSession, sf: str) -> DataFrame:
    coloured = d.output_lines(spark, sf).withColumn("line", F.concat(lit("\x1b[1;31m"), "line", lit("\x1b[0m\x1b]0;title\x07")))
    return coloured.select("output_id", "line_no", t.strip_ansi(col("line")).alias("line"))


@query("SELECT output_id, posexplode.line_no AS line_no, md5(line) AS line_md5 FROM (SELECT output_id, unnest(ls) AS line, {'line_no': (generate_subscripts(ls, 1) - 1)::INT} AS posexplode FROM (SELECT output_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT output_id, string_split_regex(text, '\\r?\\n') AS ls FROM outputs_v)))")
def src_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return x.lines_of(d.outputs(spark, sf)).select("output_id", "line_no", F.md5("line").alias("line_md5"))


@query("SELECT output_id, CASE WHEN regexp_matches(text, '^\\s*[{\\[]') THEN 'json' WHEN contains(text, '@@') OR contains(text, '```') OR len(list_filter(ls[1:50], lambda x: x = '' OR regexp_matches(x, '^[+ -]'))) * 2 > len(ls[1:50]) THEN 'code' WHEN len(list_filter(ls[1:100], lambda x: contains(x, ':') OR contains(x, '|'))) * 2 > len(ls[1:100]) THEN 'structured' ELSE 'text' END AS content_type FROM (SELECT output_id, text, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT *, string_split_regex(text, '\\r?\\n') AS ls FROM outputs_v))")
def fn_content_type(spark: SparkSession, sf: str) -> DataFrame:
    return d.outputs(spark, sf).select("output_id", t.content_type(col("text")).alias("content_type"))


@query("SELECT doc_id, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y)) / u END AS similarity FROM (SELECT doc_id, list_distinct(string_split(lang, '')) AS x, list_distinct(string_split(source, '')) AS y, len(list_distinct(list_concat(x, y))) AS u FROM documents)")
def fn_char_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "documents").select("doc_id", t.char_similarity(col("lang"), col("source")).alias("similarity"))


@query("SELECT output_id, profile, least(n, hunk_lines) AS hunk_lines, least(n, status_files) AS status_files FROM (SELECT output_id, count(*) AS n FROM output_lines_v GROUP BY 1), (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in PROFILES.items()) + ") p(profile, hunk_lines, status_files)")
def fn_profile_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of each output the profiles show, as a hunk and as a status."""
    limits = F.array(*[F.struct(lit(k).alias("profile"), lit(a).alias("hunk_lines"), lit(b).alias("status_files")) for k, (a, b) in PROFILES.items()])
    n = d.output_lines(spark, sf).groupBy("output_id").agg(F.count("*").alias("n")).select("output_id", "n", F.inline(limits))
    return n.select("output_id", "profile", *[F.least("n", c).alias(c) for c in ("hunk_lines", "status_files")])


@query(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {r.SUBCOMMAND_TOKENS['Git', 'log']} WHEN 1 THEN {r.CATEGORY_TOKENS['Infra']} ELSE {r.DEFAULT_TOKENS} END::BIGINT AS tokens FROM events")
def fn_category_tokens(spark: SparkSession, sf: str) -> DataFrame:
    n = col("event_id")
    category = F.when(n % 3 == 0, "Git").when(n % 3 == 1, "Infra").otherwise("Elsewhere")
    return d.read(spark, sf, "events").select("event_id", discovery.category_tokens(category, F.when(n % 3 == 0, "log")).alias("tokens"))


@query(f"SELECT a.session_id, a.sequence_index, array_to_string(a.w[1:2], ' ') = array_to_string(b.w[1:2], ' ') AND s > 0.9 AND s < 1 AS only_path FROM (SELECT a.*, b.w AS bw, {similarity_sql('a.w', 'b.w')} AS s FROM calls_w a JOIN calls_w b ON a.session_id = b.session_id AND a.sequence_index + 1 = b.sequence_index) a, LATERAL (SELECT a.bw AS w) b")
def fn_path_only_diff(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.tool_calls(spark, sf).filter("output_content is not null").select("session_id", "sequence_index", "command")
    after = calls.select("session_id", (col("sequence_index") - 1).alias("sequence_index"), col("command").alias("next"))
    return calls.join(after, ["session_id", "sequence_index"]).select("session_id", "sequence_index", c.path_only_difference(col("command"), col("next")).alias("only_path"))


@query("SELECT a.session_id, a.sequence_index, list_sort(list_distinct(list_intersect(a.aw, b.aw))) AS both, len(list_distinct(list_concat(a.aw, b.aw))) AS either FROM calls_w a JOIN calls_w b ON a.session_id = b.session_id AND a.sequence_index + 1 = b.sequence_index")
def set_token_ops(spark: SparkSession, sf: str) -> DataFrame:
    calls = d.tool_calls(spark, sf).filter("output_content is not null").select("session_id", "sequence_index", c.words(col("command")).alias("w"))
    after = calls.select("session_id", (col("sequence_index") - 1).alias("sequence_index"), col("w").alias("v"))
    return calls.join(after, ["session_id", "sequence_index"]).select("session_id", "sequence_index", F.array_sort(F.array_intersect("w", "v")).alias("both"), F.size(F.array_union("w", "v")).cast("long").alias("either"))


@query("SELECT base_command, error_class, diff_token, occurrences FROM (SELECT base_command, error_class, diff_token, count(*) AS occurrences FROM (SELECT *, " + "CASE WHEN len(gone) > 0 AND len(new) > 0 THEN gone[1] || ' → ' || new[1] WHEN len(gone) > 0 THEN 'removed ' || gone[1] WHEN len(new) > 0 THEN 'added ' || new[1] ELSE 'unknown' END" + " AS diff_token FROM (SELECT *, array_to_string(w[1:2], ' ') AS base_command, list_filter(aw, lambda v: NOT list_contains(naw, v)) AS gone, list_filter(naw, lambda v: NOT list_contains(aw, v)) AS new FROM corrections_v WHERE confidence >= 0.75)) GROUP BY 1, 2, 3)")
def flt_min_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return corrections.rules(corrections.corrections(d.tool_calls(spark, sf)), min_confidence=0.75).select("base_command", "error_class", "diff_token", "occurrences")


@query("SELECT idx, pattern, target, category, savings_pct, coalesce(n, 0) AS commands FROM rule_rows_v LEFT JOIN (SELECT m.r.idx AS i, count(*) AS n FROM shell_parts_v JOIN matched_v m USING (part) GROUP BY 1) ON i = idx")
def src_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules, with the commands of all calls that each decides."""
    from thriftline.plans.discovery import parts

    return discovery.rule_hits(parts(spark, sf), r.rule_table(spark)).select("idx", "pattern", "target", "category", "savings_pct", "commands")


@query("SELECT count(*) AS commands, count(DISTINCT session_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM commands_v")
def src_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = d.commands(spark, sf).agg(F.count("*").alias("commands"), F.countDistinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return facts.withColumns({k: col(k).cast("timestamp_ntz") for k in ("first_ts", "last_ts")})


@query("SELECT count(*) AS commands FROM commands_v WHERE project_path = '/w/p7' OR starts_with(project_path, '/w/p7/')")
def flt_project_lookup(spark: SparkSession, sf: str) -> DataFrame:
    facts = d.commands(spark, sf)
    path = telemetry.find_project(facts.filter(~col("project_path").endswith("/sub")), "W/P7")
    return telemetry.in_project(facts, path).agg(F.count("*").alias("commands"))


@query("SELECT output_id, code, min(n) AS first_at FROM tool_rows_v GROUP BY 1, 2")
def set_dedup_services(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct names of each output, by their first place."""
    return d._tool_rows(spark, sf).groupBy("output_id", "code").agg(F.min("n").alias("first_at"))


@query("""WITH p AS (SELECT output_id, file, code, count(*) AS n FROM tool_rows_v GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY output_id, file ORDER BY n DESC, code) AS i FROM p),
a AS (SELECT output_id, 'file' AS kind, file AS name, sum(n)::BIGINT AS n, list(code ORDER BY i) FILTER (i <= 3) AS linters FROM l GROUP BY ALL
UNION ALL SELECT output_id, 'linter', code, sum(n)::BIGINT, NULL FROM p GROUP BY ALL)
SELECT * EXCLUDE (rank), rank FROM (SELECT *, row_number() OVER (PARTITION BY output_id, kind ORDER BY n DESC, name)::INT AS rank FROM a) WHERE rank <= 10""")
def agg_linters_files(spark: SparkSession, sf: str) -> DataFrame:
    """Per output the ten linters and the ten files with the most issues, files with their three most frequent linters."""
    from thriftline.plans.extraction import golangci_outputs

    return x.linters_and_files(x.golangci(golangci_outputs(spark, sf)))


@query("""WITH p AS (SELECT output_id, 'p' || n % 3 AS package, count(*) FILTER (n % 6 = 0) AS passed, count(*) FILTER (n % 6 = 1) AS failed, count(*) FILTER (n % 6 = 2) AS skipped, count(*) FILTER (n % 6 = 4 AND n % 5 > 2) > 0 AS build_failed FROM tool_rows_v WHERE n % 6 <> 5 GROUP BY 1, 2)
SELECT output_id, package, 1::BIGINT AS packages, passed, failed, skipped, build_failed::BIGINT AS build_failures FROM p UNION ALL SELECT output_id, NULL, count(*), sum(passed)::BIGINT, sum(failed)::BIGINT, sum(skipped)::BIGINT, count(*) FILTER (build_failed) FROM p GROUP BY 1""")
def agg_test_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Passed, failed and skipped tests and failed builds by package, and in all."""
    n = col("n")
    action = F.element_at(F.array(*map(lit, ("pass", "fail", "skip", "run", "fail", "build-output"))), (n % 6 + 1).cast("int"))
    test = F.when(n % 6 < 4, F.concat(lit("T"), n))
    event = F.struct(action.alias("Action"), F.when(n % 6 != 5, F.concat(lit("p"), n % 3)).alias("Package"), test.alias("Test"), F.when((n % 6 == 4) & (n % 5 > 2), "q").alias("FailedBuild"), F.when(n % 6 == 5, "q").alias("ImportPath"))
    return x.go_packages(d.tool_text(spark, sf, F.to_json(event), numbered=False))


PLAYWRIGHT_SQL = """SELECT n AS output_id, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN n % 50 + n % 4 + 1 ELSE 0 END AS total, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN n % 50 ELSE 0 END AS passed,
CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN n % 4 ELSE 0 END AS failed, CASE n % 3 WHEN 0 THEN n % 2 WHEN 1 THEN 1 ELSE 0 END AS skipped, CASE n % 3 WHEN 0 THEN n % 900 WHEN 1 THEN (n % 90) * 1000 END AS duration_ms,
CASE n % 3 WHEN 0 THEN ['a.spec.ts: outer: ' || message, 'inner: deep: Test failed'] WHEN 1 THEN ['x/f.spec.ts: ✗ 1 chrome › x/f.spec.ts: '] ELSE [] END AS failures, n % 3 + 1 AS parse_tier FROM tool_rows_v"""


@query(PLAYWRIGHT_SQL)
def ext_playwright(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of suites in suites; every third output is text with a summary, every third neither."""
    n = col("n")
    inner = F.to_json(F.struct(lit("inner").alias("title"), F.array(F.struct(lit("deep").alias("title"), lit(False).alias("ok"))).alias("specs")))
    spec = lambda title, ok: F.struct(lit(title).alias("title"), lit(ok).alias("ok"), F.array(F.struct(lit("unexpected").alias("status"), F.array(F.struct(lit("timedOut").alias("status"), F.array(F.struct("message")).alias("errors"))).alias("results"))).alias("tests"))
    outer = F.to_json(F.struct(lit("A").alias("title"), lit("a.spec.ts").alias("file"), F.array(spec("outer", False), spec("fine", True)).alias("specs")))
    nested = F.concat(F.expr("substring(o, 1, length(o) - 1)"), lit(',"suites":['), "i", lit("]}"))
    stats = F.to_json(F.struct(lit(1).alias("expected"), lit(2).alias("unexpected"), (n % 2).alias("skipped"), (n % 900 + 0.5).alias("duration")))
    said = F.concat(lit("✗ 1 chrome › x/f.spec.ts\n"), n % 4, lit(" failed\n1 skipped\n"), n % 50, lit(" passed ("), n % 90, lit("s)"))
    rows = d._tool_rows(spark, sf).withColumns({"i": inner, "o": outer}).withColumn("suite", nested)
    text = F.when(n % 3 == 0, F.concat(lit('{"suites":['), "suite", lit('],"stats":'), stats, lit("}"))).when(n % 3 == 1, said).otherwise("nothing")
    p = x.playwright(rows.select(n.alias("output_id"), text.alias("text")))
    return p.withColumn("failures", F.transform("failures", lambda f: F.concat_ws(": ", f["file"], f["test"], f["error"])))


#: The declarative rules of the query, as their files say them; one is broken and one has an unknown strategy.
FILTER_LINES = (
    '{"origin":"user","command":"cargo","strategy":"filter","drop_pattern":"a"}',
    '{"origin":"project","command":"cargo test","strategy":"truncate","max_lines":3,"keep_pattern":"the"}',
    '{"origin":"project","command":"log","strategy":"group","drop_pattern":"e.$","keep_pattern":"^[a-f]"}',
    '{"origin":"user","command":"npm","strategy":"deduplicate","drop_pattern":"^[m-z]"}',
    '{"origin":"user","command":"pytest","strategy":"shuffle"}',
    '{"origin":"user","command":"git',
)
KEPT = "(coalesce(regexp_matches(x, k), false) OR NOT coalesce(regexp_matches(x, dr), false))"


@query(f"""WITH r AS (SELECT * FROM (VALUES ('cargo test', 'cargo test', 'truncate', 'the', NULL), ('npm run build', 'npm', 'deduplicate', NULL, '^[m-z]'), ('kubectl logs', 'log', 'group', '^[a-f]', 'e.$'), ('git log', 'log', 'group', '^[a-f]', 'e.$'), ('pytest -q', 'pytest', 'shuffle', NULL, NULL)) r(cmd, rule, s, k, dr)),
l AS (SELECT *, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS ls FROM (SELECT o.*, r.*, string_split_regex(text, '\\r?\\n') AS a FROM outputs_v o JOIN r ON cmd = command)),
f AS (SELECT *, list_filter(ls, lambda x: {KEPT}) AS kept FROM l),
t AS (SELECT output_id, rule, text, CASE s WHEN 'truncate' THEN array_to_string(list_filter(ls, lambda x, i: i > len(ls) - 3 OR regexp_matches(x, k)), chr(10)) WHEN 'deduplicate' THEN array_to_string(list_filter(kept, lambda x, i: list_position(kept, x) = i), chr(10))
WHEN 'group' THEN array_to_string(list_filter(kept, lambda x, i: regexp_matches(x, k) OR i = 1 OR x <> kept[i - 1]), chr(10)) ELSE text END AS reduced FROM f)
SELECT output_id, rule, strlen(reduced)::BIGINT AS bytes, md5(reduced) AS reduced_md5, reduced <> text AS changed FROM t""")
def src_filter_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule files as JSON lines, applied to all outputs: the project's rules come before the user's, broken ones are skipped."""
    lines = spark.range(1).select(F.posexplode(F.array(*map(lit, FILTER_LINES))).alias("line_no", "value"))
    reduced = listing.apply_filter_rules(d.outputs(spark, sf), listing.filter_rules(lines))
    return reduced.select("output_id", col("rule.command").alias("rule"), F.octet_length("reduced").cast("long").alias("bytes"), F.md5("reduced").alias("reduced_md5"), (col("reduced") != col("text")).alias("changed"))


@query()
def src_file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The files that the given tables consist of."""
    return listing.file_inventory(spark, sf)


@query("SELECT output_id, file, message FROM (SELECT *, dense_rank() OVER (PARTITION BY output_id ORDER BY file) AS f, row_number() OVER (PARTITION BY output_id, file ORDER BY line, col, message) AS m FROM eslint_v) WHERE f <= 5 AND m <= 2")
def agg_group_by_file(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    from thriftline.plans.extraction import eslint_outputs

    diag = x.eslint(eslint_outputs(spark, sf)).withColumn("f", F.dense_rank().over(Window.partitionBy("output_id").orderBy("file"))).filter("f <= 5")
    return diag.withColumn("m", F.row_number().over(Window.partitionBy("output_id", "file").orderBy("line", "col", "message"))).filter("m <= 2").select("output_id", "file", "message")
