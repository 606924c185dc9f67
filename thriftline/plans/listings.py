"""Queries of paths, listings, tool lines and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.functions import numbers, paths
from thriftline.operators import listing as op
from thriftline.operators import telemetry as t
from thriftline.plans.corrections import quoted
from thriftline.plans.registry import query, view
from thriftline.sources import derived as d

FOLDERS = ("/home/u/app/src/x", "/opt/lib/y", "a/tests", "node_modules/z", "/w/p/q/r/s", "docs")
EXTS = (".rs", ".py", ".tsx", "", ".md", ".hpp", ".tar.gz")
KEYS = ("PATH", "RUST_LOG", "AWS_REGION", "EDITOR", "HOME", "GOPATH_X", "K8S_NS", "USER")
view("files_v", f"SELECT event_id AS id, [{', '.join(map(quoted, FOLDERS))}][event_id % {len(FOLDERS)} + 1] || '/file' || event_id % 50 || [{', '.join(map(quoted, EXTS))}][event_id % {len(EXTS)} + 1] AS path FROM events")


def pick(texts: tuple[str, ...], n: str = "event_id"):
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col(n) % len(texts) + 1).cast("int"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(pick(FOLDERS), F.lit("/file"), F.col("event_id") % 50, pick(EXTS)).alias("path"))


@query("""SELECT id, CASE WHEN contains(path, '/src/') THEN 'src/' || regexp_extract(path, '.*/src/(.*)', 1) WHEN contains(path, '/lib/') THEN 'lib/' || regexp_extract(path, '.*/lib/(.*)', 1) WHEN contains(path, '/tests/') THEN 'tests/' || regexp_extract(path, '.*/tests/(.*)', 1) ELSE string_split(path, '/')[-1] END AS compact,
CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) + starts_with(path, '/')::INT <= 4 THEN path ELSE CASE WHEN starts_with(path, '/') THEN '/.../' ELSE '.../' END || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] END AS short,
CASE WHEN regexp_matches(path, '\\.rs$') THEN 'rust' WHEN regexp_matches(path, '\\.py$') THEN 'python' WHEN regexp_matches(path, '\\.tsx$') THEN 'typescript' WHEN regexp_matches(path, '\\.hpp$') THEN 'cpp' ELSE 'unknown' END AS language, regexp_matches(path, '^.*file1.\\.[^/]*$') AS globbed FROM files_v""")
def fn_paths(spark: SparkSession, sf: str) -> DataFrame:
    """fn_compact_path, fn_shorten_path, fn_filter_language and fn_glob_match on every file."""
    p = F.col("path")
    return files(spark, sf).select("id", paths.compact_path(p).alias("compact"), paths.shorten_path(p).alias("short"), paths.language(p).alias("language"), paths.glob_match("*file1?.*", p).alias("globbed"))


@query(f"SELECT event_id, ['path', 'language', 'cloud', 'tool', 'other', 'path', 'cloud', 'other'][event_id % {len(KEYS)} + 1] AS kind FROM events")
def fn_env_category(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "events").select("event_id", paths.variable_kind(pick(KEYS)).alias("kind"))


@query("SELECT id, CASE WHEN trim(project_name) <> '' THEN project_name WHEN id % 2 = 0 THEN 'repo' || id % 5 ELSE nullif(string_split(project_path, '/')[-1], '') END AS name FROM commands_v")
def fn_project_name(spark: SparkSession, sf: str) -> DataFrame:
    remote = F.when(F.col("id") % 2 == 0, F.concat(F.lit("git@host:team/repo"), F.col("id") % 5, F.lit(".git")))
    return d.commands(spark, sf).select("id", paths.project_name(F.col("project_name"), remote, F.col("project_path")).alias("name"))


@query(f"SELECT count(*) AS files FROM files_v WHERE NOT list_has_any(string_split(path, '/'), [{', '.join(map(quoted, paths.NOISE_NAMES))}])")
def flt_noise_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return op.without_noise(files(spark, sf)).agg(F.count("*").alias("files"))


@query("SELECT CASE WHEN contains(string_split(path, '/')[-1], '.') THEN '.' || string_split(path, '.')[-1] ELSE 'no ext' END AS ext, count(*) AS files FROM files_v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg_files_by_ext(spark: SparkSession, sf: str) -> DataFrame:
    return op.by_extension(files(spark, sf))


@query("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files FROM files_v GROUP BY 1")
def agg_files_by_dir(spark: SparkSession, sf: str) -> DataFrame:
    return op.by_folder(files(spark, sf))


@query("SELECT path, id FROM (SELECT *, row_number() OVER (ORDER BY path, id) AS n FROM files_v) WHERE n <= 200")
def win_budget(spark: SparkSession, sf: str) -> DataFrame:
    return op.budgeted(files(spark, sf), "path", "id", 200).select("path", "id")


NPM = ("> app@1.0 build", "npm WARN old", "  npm notice new", "⸩ 12%", "a...", "", "built in 3s", "error: x")
PLAN = ("  # aws_s3.a will be created", "# m.b must be replaced", "Plan: 1 to add", "noise", "  # note only")
STATUS = ("On branch main", "  (use \"git add\" to update)", "", "M  a.rs", "nothing to commit, working tree clean", "after")
LINES_SQL = "SELECT output_id, n AS line_no, [{}][n % {} + 1] AS line FROM tool_rows_v"
view("npm_v", LINES_SQL.format(", ".join(map(quoted, NPM)), len(NPM)))
view("plan_v", LINES_SQL.format(", ".join(map(quoted, PLAN)), len(PLAN)))
view("status_v", LINES_SQL.format(", ".join(map(quoted, STATUS)), len(STATUS)))


def tool_lines(spark: SparkSession, sf: str, texts: tuple[str, ...]) -> DataFrame:
    return d._tool_rows(spark, sf).select("output_id", F.col("n").alias("line_no"), pick(texts, "n").alias("line"))


@query("SELECT * FROM npm_v WHERE line IN ('built in 3s', 'error: x')")
def flt_package_noise(spark: SparkSession, sf: str) -> DataFrame:
    return op.package_noise_gone(tool_lines(spark, sf, NPM))


@query("SELECT output_id, line_no, CASE WHEN contains(line, 'created') THEN 'aws_s3.a' ELSE 'm.b' END AS address, CASE WHEN contains(line, 'created') THEN 'created' ELSE 'replaced' END AS action FROM plan_v WHERE contains(line, ' be ')")
def flt_infra_lines(spark: SparkSession, sf: str) -> DataFrame:
    return op.infra_changes(tool_lines(spark, sf, PLAN))


@query("SELECT output_id, line_no, line FROM (SELECT *, min(line_no) FILTER (contains(line, 'tree clean')) OVER (PARTITION BY output_id) AS e FROM status_v) WHERE (e IS NULL OR line_no <= e) AND line <> '' AND NOT contains(line, '(use')")
def flt_status_hints(spark: SparkSession, sf: str) -> DataFrame:
    return op.status_lines(tool_lines(spark, sf, STATUS))


RULES = ((2, "cargo", "filter"), (1, "cargo test", "truncate"), (3, "log", "group"), (0, "nothing", "group"))


@query(f"SELECT output_id, min({{'p': priority, 'c': r.command, 's': strategy}}).c AS rule, min({{'p': priority, 'c': r.command, 's': strategy}}).s AS strategy FROM outputs_v o LEFT JOIN (VALUES {', '.join(f'({p}, {quoted(c)}, {quoted(s)})' for p, c, s in RULES)}) r(priority, command, strategy) ON contains(o.command, r.command) GROUP BY 1")
def join_filter_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(c).alias("command"), F.lit(s).alias("strategy")) for p, c, s in RULES])))
    return op.matching_rule(d.outputs(spark, sf).select("output_id", "command"), rules).select("output_id", F.col("rule.command").alias("rule"), F.col("rule.strategy").alias("strategy"))


@query("SELECT output_id, count(*) FILTER (regexp_matches(lower(line), 'compiling|compiled')) AS compiled, count(*) FILTER (contains(lower(line), 'error') AND NOT contains(lower(line), '0 error')) AS errors, count(*) FILTER (contains(lower(line), 'warning') AND NOT contains(lower(line), '0 warning')) AS warnings FROM output_lines_v GROUP BY 1")
def agg_quick_build(spark: SparkSession, sf: str) -> DataFrame:
    return op.build_counts(d.output_lines(spark, sf))


@query("SELECT output_id, count(*) AS suites, sum(n % 50)::BIGINT AS passed, sum(n % 3)::BIGINT AS failed, sum(n % 2)::BIGINT AS ignored FROM tool_rows_v WHERE n % 4 <> 0 GROUP BY 1")
def agg_test_suites(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    line = F.when(n % 4 == 0, "running 3 tests").otherwise(F.concat(F.lit("test result: ok. "), n % 50, F.lit(" passed; "), n % 3, F.lit(" failed; "), n % 2, F.lit(" ignored; 0 measured")))
    return op.suites(d._tool_rows(spark, sf).select("output_id", line.alias("line")))


@query("SELECT output_id, count(*) FILTER (n % 5 IN (0, 1)) AS passed, count(*) FILTER (n % 5 IN (2, 3)) AS failed, count(*) FILTER (n % 5 = 4) AS pending, list_sort(list_distinct(list(code) FILTER (n % 5 IN (2, 3)))) AS failed_names FROM tool_rows_v GROUP BY 1 HAVING count(*) FILTER (n % 5 IN (2, 3)) > 0")
def agg_ci_checks(spark: SparkSession, sf: str) -> DataFrame:
    checks = d._tool_rows(spark, sf).select("output_id", F.col("code").alias("name"), pick(("pass", "success", "fail", "failure", "queued"), "n").alias("state"))
    return op.ci_checks(checks).filter("failed > 0")


@query("SELECT output_id, count(*) AS images, sum(CASE n % 3 WHEN 0 THEN 1024.0::DOUBLE * (n % 9) WHEN 1 THEN (n % 9) ELSE 0 END) AS mb FROM tool_rows_v GROUP BY 1")
def agg_images(spark: SparkSession, sf: str) -> DataFrame:
    return op.image_sizes(d._tool_rows(spark, sf).select("output_id", F.concat(F.col("n") % 9, pick(("GB", "MB", "kB"), "n")).alias("size")))


@query("""SELECT status, count(*) AS pairs, sum(CASE WHEN status = 'raw' THEN input_tokens ELSE output_tokens END)::BIGINT AS tokens FROM (SELECT *, CASE WHEN input_tokens > 0 AND (output_tokens = 0 OR s < 0.2 OR (parse_tier = 2 AND s < 0.4) OR (exec_time_ms < 200 AND s > 0.95)) THEN 'raw' ELSE 'reduced' END AS status FROM (SELECT *, 1 - output_tokens::DOUBLE / input_tokens AS s FROM commands_v)) GROUP BY 1""")
def agg_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """fn_validate_reduction over all commands, summed up by what was kept."""
    pairs = d.commands(spark, sf).select(F.col("input_tokens").alias("raw_tokens"), F.col("output_tokens").alias("reduced_tokens"), F.col("exec_time_ms").alias("raw_lines"), (F.col("parse_tier") == 2).alias("degraded"))
    return op.validated(pairs).groupBy("status").agg(F.count("*").alias("pairs"), F.sum("tokens").alias("tokens"))


@query("SELECT output_id, file, line AS at, 'x:' || message AS text FROM tool_rows_v WHERE n % 4 <> 0")
def ext_grep_hits(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("n") % 4 == 0, F.lit("Binary file matches")).otherwise(F.concat_ws(":", "file", "line", F.lit("x"), "message"))
    return op.grep_hits(d._tool_rows(spark, sf).select("output_id", line.alias("line")))


@query("SELECT doc_id, CASE WHEN length(t) <= 90 THEN t ELSE CASE WHEN s > 1 THEN '...' ELSE '' END || substr(t, s, 90) || CASE WHEN s + 90 <= length(t) THEN '...' ELSE '' END END AS shown FROM (SELECT *, greatest(least(greatest(instr(lower(t), 'ent'), 1) - 30, length(t) - 89), 1) AS s FROM (SELECT doc_id, trim(text) AS t FROM documents))")
def fn_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return d.read(spark, sf, "documents").select("doc_id", op.snippet(F.col("text"), "ent", 90).alias("shown"))


@query("SELECT page_id, strlen(html) <= 2000 AS fits FROM pages")
def flt_size_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Pages within a size, and those beside it."""
    return d.read(spark, sf, "pages").select("page_id", (F.octet_length("html") <= 2000).alias("fits"))
