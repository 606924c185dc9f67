"""Queries of test runs and their failures, dependency trees and manifests, and of JSON forms. Inputs hold what does not fit, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions import json as j
from thriftline.operators import extraction as x
from thriftline.operators import manifests, sections, trees
from thriftline.operators import reduction as red
from thriftline.operators import testruns as op
from thriftline.plans import economics as econ
from thriftline.plans.more import json_rows
from thriftline.plans.registry import query, view
from thriftline.plans.sections import cargo_lines, text_of
from thriftline.sources import derived as d

col, lit = F.col, F.lit


def said(*parts):
    """parts joined; texts are literals, columns are columns."""
    return F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])


@query("""SELECT output_id, 'test_' || n AS name, 'assert 1 == ' || n AS message, 'a.py:' || n AS location, ['>       assert x == ' || n, 'E       assert 1 == ' || n, 'E  more'] AS relevant FROM (
SELECT *, last_value(CASE n % 5 WHEN 0 THEN 'failures' WHEN 2 THEN 'other' END IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY n) AS state FROM tool_rows_v) WHERE n % 5 IN (1, 3) AND state = 'failures'""")
def ext_pytest_failures(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    block = said("____ test_", n, " ____\n    def test():\n>       assert x == ", n, "\nE       assert 1 == ", n, "\nE  more\n\na.py:", n, ": AssertionError")
    line = F.when(n % 5 == 0, "==== FAILURES ====").when(n % 5 == 2, "==== short test summary info ====").when(n % 5 == 4, said("==== 3 failed, ", n % 50, " passed in 1s ====")).otherwise(block)
    return op.pytest_blocks(text_of(spark, sf, line)).select("output_id", "name", "message", "location", "relevant")


@query("SELECT output_id, 'm' || n % 9 AS name, n % 3 <> 0 AS passed FROM tool_rows_v WHERE n % 5 <> 0")
def ext_cargo_test(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    line = F.when(n % 5 == 0, "running 9 tests").otherwise(said("test m", n % 9, " ... ", F.when(n % 3 != 0, "ok").otherwise("FAILED")))
    return op.cargo_tests(x.lines_of(d.tool_text(spark, sf, line, numbered=False)))


@query("""SELECT output_id, '---- t::' || n || ' stdout ----' AS name, 'thread x panicked at ' || n || chr(10) || '   ... (2 internal frames)' || chr(10) || '   2: mine' || chr(10) || '   ... (1 internal frames)' AS body FROM (
SELECT *, last_value(CASE n % 4 WHEN 0 THEN 'in' WHEN 2 THEN 'out' END IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY n) AS state FROM tool_rows_v) WHERE n % 4 = 1 AND state = 'in'""")
def ext_cargo_failures(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    block = said("---- t::", n, " stdout ----\nthread x panicked at ", n, "\n   0: std::panicking\n   1: at /rustc/abc\n   2: mine\n   3: <core::x>\n")
    line = F.when(n % 4 == 0, "failures:").when(n % 4 == 1, block).when(n % 4 == 2, "test result: FAILED. 1 passed; 1 failed; 0 ignored; 0 measured; 0 filtered out").otherwise(said("test a::", n, " ... ok"))
    return op.cargo_blocks(text_of(spark, sf, line)).select("output_id", "name", "body")


def nextest_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    fail = said("    FAIL [   0.02s] crate t", n, "\n  stdout ───\n    boom ", n)
    line = F.when(n % 397 == 396, said("     Summary [   1.50s] ", n, " tests run: ", n % 7, " passed, 1 failed")).when(n % 4 == 0, said("    PASS [   0.01s] crate t", n)).when(n % 4 == 1, fail).when(n % 4 == 2, "  ────────────").otherwise("   Compiling x v1")
    return text_of(spark, sf, line)


@query("""SELECT output_id, 'FAIL [   0.02s] crate t' || n AS name, '  stdout ───' || chr(10) || '    boom ' || n AS body FROM (
SELECT *, count(*) FILTER (n % 397 = 396) OVER (PARTITION BY output_id ORDER BY n) AS over_ FROM tool_rows_v) WHERE n % 4 = 1 AND n % 397 <> 396 AND over_ = 0""")
def ext_nextest_failures(spark: SparkSession, sf: str) -> DataFrame:
    return op.nextest_blocks(nextest_lines(spark, sf)).select("output_id", "name", "body")


@query("SELECT output_id, 1.5::DOUBLE AS seconds, min(n) AS run, arg_min(n % 7, n) AS passed, 1::BIGINT AS failed, 0::BIGINT AS skipped FROM tool_rows_v WHERE n % 397 = 396 GROUP BY 1")
def ext_nextest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return op.nextest_summary(nextest_lines(spark, sf))


@query("""SELECT n AS output_id, CASE n % 4 WHEN 2 THEN 0 WHEN 1 THEN n % 50 + 1 ELSE 3 END AS total, CASE n % 4 WHEN 2 THEN 0 WHEN 1 THEN n % 50 ELSE 1 END AS passed, CASE n % 4 WHEN 2 THEN 0 ELSE 1 END AS failed, CASE WHEN n % 4 IN (0, 3) THEN 1 ELSE 0 END AS skipped,
CASE n % 4 WHEN 1 THEN 1500 WHEN 2 THEN NULL ELSE n % 900 END AS duration_ms, CASE n % 4 WHEN 1 THEN [' FAIL  a.ts > t' || n || '||Error: boom' || chr(10) || 'at x'] WHEN 2 THEN [] ELSE ['b {' || n || '|f.ts|"q" }' || chr(10) || 'second'] END AS failures,
CASE WHEN n % 4 IN (0, 3) THEN ['a ' || n] ELSE [] END AS passed_names, CASE n % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS parse_tier FROM tool_rows_v""")
def ext_vitest(spark: SparkSession, sf: str) -> DataFrame:
    """Reports alone and behind a banner that holds braces, summaries of texts, and texts without either."""
    n = col("n")
    test = lambda name, status, *messages: F.struct(name.alias("fullName"), lit(status).alias("status"), F.array(*[lit(m) for m in messages]).cast("array<string>").alias("failureMessages"))
    tests = F.array(test(said("a ", n), "passed"), test(said("b {", n), "failed", '"q" }', "second"), test(said("c ", n), "pending"))
    report = F.to_json(F.struct(*[lit(v).alias(f"num{k}Tests") for k, v in (("Total", 3), ("Passed", 1), ("Failed", 1), ("Pending", 1))], lit(5).alias("startTime"), (n % 900 + 5).alias("endTime"), F.array(F.struct(lit("f.ts").alias("name"), tests.alias("assertionResults"))).alias("testResults")))
    text = said(" FAIL  a.ts > t", n, "\n  Error: boom\n    at x\nother\nTests  1 failed | ", n % 50, " passed\nDuration  1.5s (in 3)")
    return op.vitest(d._tool_rows(spark, sf).select(n.alias("output_id"), F.when(n % 4 == 0, said("> run {x} {\"a\": {}\n", report, "\ndone }")).when(n % 4 == 1, text).when(n % 4 == 2, "no { report").otherwise(report).alias("text"))).withColumn(
        "failures", F.transform("failures", lambda f: F.concat_ws("|", f["test"], f["file"], f["error"]))
    )


view("quick_v", """SELECT output_id, n, n % 7 AS k, CASE n % 7 WHEN 0 THEN n || ' passed' WHEN 1 THEN 'OK' WHEN 2 THEN n || '  Failed' WHEN 3 THEN '0 failed' WHEN 4 THEN 'test x ... ok' WHEN 5 THEN n % 9 || ' ignored' ELSE 'FAIL y' || n END AS line,
  last_value(CASE WHEN n % 7 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p FROM tool_rows_v""")


@query("""SELECT output_id, coalesce(max(p), 0) + count(*) FILTER (k IN (1, 4) AND n > coalesce(p, -1)) AS passed, coalesce(arg_max(CASE k WHEN 2 THEN n ELSE 0 END, n) FILTER (k IN (2, 3)), 0) AS failed, coalesce(arg_max(n % 9, n) FILTER (k = 5), 0) AS skipped,
coalesce(list(line ORDER BY n) FILTER (k IN (2, 6) AND NOT contains(line, '0 failed')), [])[1:5] AS failures FROM quick_v GROUP BY 1""")
def agg_quick_tests(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    k = n % 7
    line = F.when(k == 0, said(n, " passed")).when(k == 1, "OK").when(k == 2, said(n, "  Failed")).when(k == 3, "0 failed").when(k == 4, "test x ... ok").when(k == 5, said(n % 9, " ignored")).otherwise(said("FAIL y", n))
    return op.quick_tests(text_of(spark, sf, line))


@query("""WITH e AS (SELECT output_id, n, 'p' || n % 3 AS package, 'T' || n % 7 AS test, n % 4 AS k FROM tool_rows_v),
f AS (SELECT *, lag(n, 1, -1) OVER (PARTITION BY output_id, package, test ORDER BY n) AS before, row_number() OVER (PARTITION BY output_id, package, test ORDER BY n) AS nth FROM e WHERE k = 1)
SELECT f.output_id, f.package, f.test, f.nth, coalesce(list('o' || o.n ORDER BY o.n) FILTER (o.n IS NOT NULL), []) AS output FROM f LEFT JOIN e o ON o.output_id = f.output_id AND o.package = f.package AND o.test = f.test AND o.k = 3 AND o.n > f.before AND o.n < f.n GROUP BY ALL""")
def join_failed_test_output(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    action = F.element_at(F.array(lit("run"), lit("fail"), lit("pass"), lit("output")), (n % 4 + 1).cast("int"))
    event = F.to_json(F.struct(action.alias("Action"), said("p", n % 3).alias("Package"), said("T", n % 7).alias("Test"), F.when(n % 4 == 3, said("o", n, " \n")).alias("Output")))
    return op.failed_test_output(op.go_events(text_of(spark, sf, F.when(n % 11 == 10, said(event, "\nno event")).otherwise(event))))


@query("SELECT output_id, n, CASE n % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'output' ELSE 'build-fail' END AS action, CASE WHEN n % 4 < 3 THEN 'p' || n % 3 END AS package FROM tool_rows_v WHERE n % 5 <> 0")
def src_ndjson_events(spark: SparkSession, sf: str) -> DataFrame:
    """Test events of lines of which every fifth is none."""
    n = col("n")
    action = F.element_at(F.array(*map(lit, ("pass", "fail", "output", "build-fail"))), (n % 4 + 1).cast("int"))
    event = F.to_json(F.struct(action.alias("Action"), F.when(n % 4 < 3, said("p", n % 3)).alias("Package"), said(n).alias("Output")))
    broken = F.element_at(F.array(lit("ok"), lit("{"), lit('{"Other": 1}'), lit(""), lit("[]")), (n % 5 + n / 5 % 5).cast("int") % 5 + 1)
    e = op.go_events(x.lines_of(d.tool_text(spark, sf, F.when(n % 5 == 0, broken).otherwise(event), numbered=False)))
    return e.select("output_id", col("Output").cast("long").alias("n"), col("Action").alias("action"), col("Package").alias("package"))


@query("SELECT a.output_id, 'i' || a.n % 4 AS package, count(DISTINCT b.n) AS errors FROM tool_rows_v a LEFT JOIN tool_rows_v b ON a.output_id = b.output_id AND a.n % 4 = b.n % 4 AND b.n % 6 = 1 WHERE a.n % 6 = 0 GROUP BY 1, 2")
def join_build_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Packages whose build failed, with the number of build errors of their import path."""
    n = col("n")
    event = F.to_json(F.struct(F.when(n % 6 == 1, "build-output").otherwise("fail").alias("Action"), F.when(n % 6 == 1, said("i", n % 4)).alias("ImportPath"), F.when(n % 6 == 0, said("i", n % 4)).alias("FailedBuild"), said("e", n).alias("Output")))
    return op.build_errors(op.go_events(x.lines_of(d.tool_text(spark, sf, event, numbered=False)), "Action string, ImportPath string, FailedBuild string, Output string"))


@query("SELECT output_id, count(*) FILTER (k IN (0, 3)) AS staged, count(*) FILTER (k IN (1, 3)) AS modified, count(*) FILTER (k = 2) AS untracked, count(*) FILTER (k = 4) AS conflicts FROM (SELECT *, CASE n % 7 WHEN 5 THEN 0 WHEN 6 THEN 9 ELSE n % 7 END AS k, row_number() OVER (PARTITION BY output_id ORDER BY n) AS r FROM tool_rows_v) GROUP BY 1")
def agg_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Status lines below a line that names the branch; AU is staged and no conflict, `x` is too short."""
    n = col("n")
    status = F.element_at(F.array(*map(lit, ("A ", " M", "??", "MD", "UU", "AU"))), (n % 7 % 6 + 1).cast("int"))
    first = F.row_number().over(Window.partitionBy("output_id").orderBy("n")) == 1
    line = F.when(n % 7 == 6, "x").otherwise(said(status, " ", col("file")))
    rows = d._tool_rows(spark, sf).withColumn("t", line).withColumn("t", F.when(first, said("UU main\n", col("t"))).otherwise(col("t")))
    lines = rows.groupBy("output_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda v: v["t"]), "\n").alias("text"))
    return x.change_counts(lines)


#: Levels of the query's dependency trees.
view("trees_v", "SELECT n, CASE WHEN n % 97 = 0 THEN 40 ELSE n % 6 END AS depth FROM tool_rows_v")


@query("""SELECT n AS output_id, 'p' || i AS name, CASE WHEN i = depth THEN '9' ELSE '1.' || i END AS version, i >= 11 AS dev, 1 AS parse_tier FROM (SELECT n, depth, unnest(range(0, depth + 1)) AS i FROM trees_v WHERE n % 3 = 0)
UNION ALL SELECT n, 'p' || n, '1.2', false, 2 FROM tool_rows_v WHERE n % 3 = 1 UNION ALL SELECT n, '@s/q', '3', false, 2 FROM tool_rows_v WHERE n % 3 = 1""")
def ext_pnpm_list(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of up to forty levels, of which the eleventh is one of development; every third output is text, every third neither."""
    n = col("n")
    rows = d._tool_rows(spark, sf).select(n.alias("output_id"), "n", F.when(n % 97 == 0, 40).otherwise(n % 6).cast("int").alias("depth"))

    def below(acc, i):
        at = col("depth") - i
        return said('{"version":"1.', at, '","', F.when((at + 1) % 11 == 0, "devDependencies").otherwise("dependencies"), '":{"p', at + 1, '":', acc, '},"other":[1]}')

    tree = said('{"p0":', F.aggregate(F.when(col("depth") > 0, F.sequence(lit(1), col("depth"))).otherwise(F.array().cast("array<int>")), lit('{"version":"9"}'), below), "}")
    text = said("Legend: x@1\n│ y@2\np", n, "@1.2 extra\n\n@s/q@3\nnone\n@\n")
    return trees.pnpm_packages(rows.select("output_id", F.when(n % 3 == 0, tree).when(n % 3 == 1, text).otherwise(F.when(n % 2 == 0, "nothing").otherwise('{"a":1}')).alias("text")))


@query("""SELECT output_id, 'p' || n AS name, '1.' || n % 5 AS current, '2.' || n % 5 AS latest, CASE WHEN n % 3 > 0 THEN '1.9' END AS wanted, n % 4 = 0 AS dev, 1 AS parse_tier FROM tool_rows_v WHERE output_id % 5 <> 0 AND output_id % 7 <> 0
UNION ALL SELECT -1 - n, 't' || n, '1', '3', '2', false, 2 FROM tool_rows_v""")
def ext_pnpm_outdated(spark: SparkSession, sf: str) -> DataFrame:
    from thriftline.plans.tools import with_broken

    n = col("n")
    kind = F.when(n % 4 == 0, "devDependencies").otherwise("dependencies")
    item = F.struct(said("p", n).alias("name"), F.struct(said("1.", n % 5).alias("current"), said("2.", n % 5).alias("latest"), F.when(n % 3 > 0, "1.9").alias("wanted"), kind.alias("dependencyType")).alias("v"))
    maps = with_broken(d._tool_blocks(spark, sf, item).select("output_id", F.to_json(F.map_from_entries("a")).alias("text")))
    text = said("Package Current Wanted Latest\n┌──┬──┐\nt", n, "  1 2\t3 more\nshort line here\nLegend: a b c d")
    return trees.pnpm_outdated(maps.unionByName(d._tool_rows(spark, sf).select((lit(-1) - n).alias("output_id"), text.alias("text"))))


MANIFEST_ID = f"output_id * 100000 + (n >> {d.BLOCK_BITS})"


@query(f"""SELECT {MANIFEST_ID} AS output_id, kind, section, name, version FROM (SELECT *, ['cargo', 'package_json', 'requirements', 'pyproject', 'gomod'][output_id % 5 + 1] AS kind,
  last_value(CASE n % 10 WHEN 0 THEN 'dependencies' WHEN 5 THEN 'dev-dependencies' WHEN 8 THEN 'package' END IGNORE NULLS) OVER (PARTITION BY output_id, n >> {d.BLOCK_BITS} ORDER BY n) AS s,
  CASE kind WHEN 'cargo' THEN CASE WHEN n % 10 NOT IN (0, 5, 8) AND s IN ('dependencies', 'dev-dependencies') THEN s END WHEN 'package_json' THEN CASE n % 3 WHEN 0 THEN 'dependencies' WHEN 1 THEN 'devDependencies' END
    WHEN 'requirements' THEN CASE WHEN n % 4 < 2 THEN 'packages' END WHEN 'pyproject' THEN 'dependencies' ELSE CASE WHEN n % 4 <> 3 THEN 'require' END END AS section,
  CASE kind WHEN 'gomod' THEN 'ex.com/m' || n ELSE 'dep' || n END AS name,
  CASE kind WHEN 'cargo' THEN '1.' || n % 7 WHEN 'package_json' THEN CASE WHEN n % 2 = 0 THEN '^' || n % 7 ELSE '*' END WHEN 'requirements' THEN CASE n % 4 WHEN 0 THEN '>=1.' || n % 7 ELSE '' END WHEN 'pyproject' THEN '==' || n % 7 ELSE 'v1.' || n % 7 END AS version
FROM tool_rows_v) WHERE section IS NOT NULL""")
def ext_manifest_deps(spark: SparkSession, sf: str) -> DataFrame:
    """Five kinds of manifests, one per user and block; each holds lines that declare nothing."""
    n, kind = col("n"), F.element_at(F.array(*map(lit, manifests.KINDS)), (col("output_id") % 5 + 1).cast("int"))
    version = said('"1.', n % 7, '"')
    cargo = F.when(n % 10 == 0, "[dependencies]").when(n % 10 == 5, "[dev-dependencies]").when(n % 10 == 8, "[package]").otherwise(said("dep", n, " = ", F.when(n % 2 == 0, version).otherwise(said("{ version = ", version, ", features = [] }"))))
    requirement = F.when(n % 4 == 0, said("dep", n, ">=1.", n % 7)).when(n % 4 == 1, said("  dep", n, " ")).when(n % 4 == 2, said("# dep", n)).otherwise(said("-r dep", n))
    module = F.when(n % 4 == 0, said("\tex.com/m", n, " v1.", n % 7, " // indirect")).when(n % 4 == 1, said(")\nrequire ex.com/m", n, " v1.", n % 7, "\nrequire (")).when(n % 4 == 2, said("// ex.com/no v1\n\tex.com/m", n, " v1.", n % 7)).otherwise(said(")\nreplace ex.com/x => y\nrequire ("))
    line = F.when(kind == "cargo", cargo).when(kind == "requirements", requirement).when(kind == "pyproject", said('  "dep', n, "==", n % 7, '",')).when(kind == "gomod", module).otherwise("")
    item = F.struct(line.alias("line"), (n % 3).alias("k"), F.struct(said("dep", n).alias("name"), F.when(n % 2 == 0, said("^", n % 7)).alias("v")).alias("d"))
    blocks = d._tool_blocks(spark, sf, item).withColumn("kind", kind).withColumn("output_id", col("output_id") * 100000 + col("part"))
    part = lambda k: F.to_json(F.map_from_entries(F.transform(F.filter("a", lambda v: v["k"] == k), lambda v: v["d"])), {"ignoreNullFields": "false"})
    package = said('{"name":"x","dependencies":', part(0), ',"devDependencies":', part(1), ',"scripts":', part(2), "}")
    body = F.array_join(F.transform("a", lambda v: v["line"]), "\n")
    text = F.when(col("kind") == "package_json", package).when(col("kind") == "pyproject", said("[project]\nname = 'x'\ndependencies = [\n", body, "\n]\nother = [\n  'no',\n]\n")).when(col("kind") == "gomod", said("module x\n\ngo 1.21\n\nrequire (\n", body, "\n)\n")).otherwise(body)
    files = blocks.select("output_id", "kind", text.alias("text"))
    return manifests.dependencies(files)


def formatted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and a JSON text with blanks for each event under a negative id."""
    rows = json_rows(spark, sf).select((lit(-1) - col("n")).alias("output_id"), said(" ", col("text"), "\n").alias("text"))
    return d.outputs(spark, sf).select("output_id", "text").unionByName(rows)


FLAT_V = "'maybe:' || CASE WHEN maybe IS NULL THEN 'null' ELSE 'x' END || CASE WHEN long = '' THEN '' ELSE '|long:' || long END || '|' || array_to_string(list_transform(items, lambda v, i: 'items[' || (i - 1) || ']:' || v), '|') || '|a.b.c.v:' || n"
BLANK_V = r"[\t-\r \x{85}\p{Z}]"  # RE2's \s lacks some of Unicode's blanks
view("forms_v", f"""
SELECT output_id, unnest([{{'format': 'raw', 'form': text}}, {{'format': 'compact', 'form': compact}}, {{'format': 'flat', 'form': flat}}]) AS x, length(text) AS raw_chars FROM (
SELECT output_id, text, trim(regexp_replace(text, '{BLANK_V}+', ' ', 'g')) AS compact, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^{BLANK_V}+|{BLANK_V}+$', '', 'g')), lambda l: l <> ''), '|') AS flat FROM outputs_v
UNION ALL SELECT -1 - n, ' ' || c || chr(10), c, flat FROM (SELECT n, '{{"maybe":' || coalesce(maybe, 'null') || ',"long":"' || long || '","items":[' || array_to_string(items, ',') || '],"a":{{"b":{{"c":{{"v":' || n || '}}}}}}}}' AS c, {FLAT_V} AS flat FROM json_v))
""")
COMPARED = "SELECT output_id, x.format AS format, ceil(length(x.form) / 4)::BIGINT AS tokens, ceil(raw_chars / 4)::BIGINT AS raw FROM forms_v"


@query(f"SELECT output_id, format, tokens, round(CASE WHEN raw > 0 AND tokens < raw THEN 100 - tokens * 100.0::DOUBLE / raw ELSE 0 END, 6) AS savings_pct FROM ({COMPARED})")
def join_format_compare(spark: SparkSession, sf: str) -> DataFrame:
    return red.compact_forms(formatted(spark, sf)).withColumn("savings_pct", F.round("savings_pct", 6))


@query(f"SELECT format, sum(tokens)::BIGINT AS tokens, round(avg(CASE WHEN raw > 0 AND tokens < raw THEN 100 - tokens * 100.0::DOUBLE / raw ELSE 0 END), 6) AS mean_savings_pct FROM ({COMPARED}) GROUP BY 1")
def agg_format_compare(spark: SparkSession, sf: str) -> DataFrame:
    return red.compact_forms(formatted(spark, sf)).groupBy("format").agg(F.sum("tokens").alias("tokens"), F.round(F.avg("savings_pct"), 6).alias("mean_savings_pct"))


@query(f"SELECT n, {FLAT_V} AS text FROM json_v")
def fn_toon(spark: SparkSession, sf: str) -> DataFrame:
    """The flat form of a JSON text."""
    return json_rows(spark, sf).select("n", j.json_flat(col("text")).alias("text"))


@query("""SELECT n, '{' || chr(10) || '  a:' || chr(10) || '  {' || chr(10) || '    b:' || chr(10) || '    {' || chr(10) || '      c:' || chr(10) || '      {' || chr(10) || '        v: int' || chr(10) || '      }' || chr(10) || '    }' || chr(10) || '  }' || chr(10)
|| '  items:' || chr(10) || CASE WHEN len(items) = 1 THEN '  [' || chr(10) || '    int' || chr(10) || '  ]' ELSE '  [int] (' || len(items) || ')' END || chr(10) || '  long: string' || CASE WHEN length(long) > 50 THEN '[' || length(long) || ']' ELSE '' END || ',' || chr(10)
|| '  maybe: ' || CASE WHEN maybe IS NULL THEN 'null' ELSE 'string' END || chr(10) || '}' AS outline FROM json_v WHERE n % 9 > 0 UNION ALL SELECT n, NULL FROM json_v WHERE n % 9 = 0""")
def fn_json_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The types of each text; every ninth is no JSON."""
    text = F.when(col("n") % 9 > 0, col("text")).otherwise(F.concat("text", lit("}")))
    return json_rows(spark, sf).select("n", j.json_types(text).alias("outline"))


@query("SELECT row_number() OVER (ORDER BY month) AS place, month, saved_tokens FROM econ_month_v")
def sort_period(spark: SparkSession, sf: str) -> DataFrame:
    """Months in order; there are few, so one task numbers them."""
    return econ.by_month(spark, sf).select(F.row_number().over(Window.orderBy("month")).cast("long").alias("place"), "month", "saved_tokens").orderBy("month")


@query("SELECT output_id, severity, file, line, code, message FROM cargo_v")
def ext_clippy(spark: SparkSession, sf: str) -> DataFrame:
    """All diagnostics of a lint run with a place: errors and warnings."""
    return sections.rust_blocks(cargo_lines(spark, sf), "clippy").select("output_id", "severity", "file", "line", "code", "message")


@query("SELECT DISTINCT output_id, file FROM tool_rows_v WHERE n % 3 = 0")
def ext_prettier(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    line = F.when(n % 3 == 0, said("[warn] ", col("file"))).when(n % 3 == 1, "[warn] Code style issues found in the above file. Forgot to run Prettier?").otherwise("Checking formatting...")
    return sections.unformatted(text_of(spark, sf, line)).filter("tool = 'prettier'").select("output_id", "file")


@query("SELECT DISTINCT output_id, file FROM tool_rows_v WHERE n % 3 = 0")
def ext_black(spark: SparkSession, sf: str) -> DataFrame:
    n = col("n")
    line = F.when(n % 3 == 0, said("would reformat ", col("file"))).when(n % 3 == 1, "Oh no! 💥 💔 💥").otherwise("3 files would be reformatted, 2 files would be left unchanged.")
    return sections.unformatted(text_of(spark, sf, line)).filter("tool = 'black'").select("output_id", "file")
