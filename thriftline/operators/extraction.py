"""Extraction of diagnostics, tests and dependencies from tool outputs (output_id, text), into three kinds of tables.

diagnostics: output_id, tool, file, line, col, severity, code, message. JSON
tools are parsed by one from_json each, text tools by patterns over their
lines. What does not parse gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions.text import strip_ansi, text_lines
from thriftline.operators.scan import chunked, count, latest, running
from thriftline.operators.trees import suite_specs, text_key

DIAGNOSTICS = ("output_id", "tool", "file", "line", "col", "severity", "code", "message")


def parsed(outputs: DataFrame, schema: str) -> DataFrame:
    """(output_id, x): the elements of a JSON array per output."""
    return outputs.select("output_id", F.explode(F.from_json("text", f"array<{schema}>")).alias("x"))


def diagnostic(df: DataFrame, tool: str, **cols: Column) -> DataFrame:
    return df.select("output_id", F.lit(tool).alias("tool"), *[cols[c].alias(c) for c in DIAGNOSTICS[2:]])


def eslint(outputs: DataFrame) -> DataFrame:
    """Messages per file; severity 2 is an error, a missing rule is unknown."""
    files = parsed(outputs, "struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,message:string,ruleId:string>>>")
    m = files.select("output_id", F.col("x.filePath").alias("f"), F.explode("x.messages").alias("m"))
    return diagnostic(m, "eslint", file=F.col("f"), line=F.col("m.line"), col=F.col("m.column"), severity=F.when(F.col("m.severity") >= 2, "error").otherwise("warning"), code=F.coalesce("m.ruleId", F.lit("unknown")), message=F.col("m.message"))


def ruff(outputs: DataFrame) -> DataFrame:
    m = parsed(outputs, "struct<code:string,message:string,location:struct<row:int,column:int>,filename:string>")
    return diagnostic(m, "ruff", file=F.col("x.filename"), line=F.col("x.location.row"), col=F.col("x.location.column"), severity=F.lit("error"), code=F.col("x.code"), message=F.col("x.message"))


def pylint(outputs: DataFrame) -> DataFrame:
    """error and fatal are errors; the code is `symbol (id)`."""
    m = parsed(outputs, "struct<type:string,path:string,line:int,column:int,symbol:string,`message-id`:string,message:string>")
    code = F.concat(F.col("x.symbol"), F.lit(" ("), F.col("x.`message-id`"), F.lit(")"))
    return diagnostic(m, "pylint", file=F.col("x.path"), line=F.col("x.line"), col=F.col("x.column"), severity=F.when(F.col("x.type").isin("error", "fatal"), "error").otherwise("warning"), code=code, message=F.col("x.message"))


def golangci(outputs: DataFrame) -> DataFrame:
    schema = "struct<Issues:array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:int,Column:int>>>>"
    m = outputs.select("output_id", F.explode(F.from_json("text", schema)["Issues"]).alias("x"))
    return diagnostic(m, "golangci", file=F.col("x.Pos.Filename"), line=F.col("x.Pos.Line"), col=F.col("x.Pos.Column"), severity=F.lit("error"), code=F.col("x.FromLinter"), message=F.col("x.Text"))


def lines_of(outputs: DataFrame) -> DataFrame:
    """(output_id, line_no, line); first_line, if outputs have it, is where a text goes on in an output of several."""
    if "first_line" not in outputs.columns:
        return outputs.select("output_id", F.posexplode(text_lines(F.col("text"))).alias("line_no", "line"))
    rows = outputs.select("output_id", "first_line", F.posexplode(text_lines(F.col("text"))).alias("i", "line"))
    return rows.select("output_id", (F.col("first_line") + F.col("i")).cast("int").alias("line_no"), "line")


def by_pattern(lines: DataFrame, tool: str, pattern: str, groups: dict[str, int], severity: Column | None = None) -> DataFrame:
    """Diagnostics from lines that match pattern; groups names the pattern's groups."""
    hit = lines.filter(F.col("line").rlike(pattern))
    g = lambda n: F.nullif(F.regexp_extract("line", pattern, groups[n]), F.lit("")) if n in groups else F.lit(None).cast("string")
    return diagnostic(hit, tool, file=g("file"), line=g("line").cast("int"), col=g("col").cast("int"), severity=severity if severity is not None else g("severity"), code=g("code"), message=g("message"))


MYPY = r"^(.+?):(\d+)(?::(\d+))?: (error|warning|note): (.+?)(?:  \[([a-z0-9-]+)\])?$"
TSC = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)$"
GO_BUILD = r"^(.+?\.go):(\d+):(?:(\d+):)? (.+)$"


def mypy(outputs: DataFrame) -> DataFrame:
    """Errors and warnings; notes are context of the error before them and give no row."""
    d = by_pattern(lines_of(outputs), "mypy", MYPY, {"file": 1, "line": 2, "col": 3, "severity": 4, "message": 5, "code": 6})
    return d.filter("severity <> 'note'")


def mypy_notes(outputs: DataFrame) -> DataFrame:
    """(output_id, file, line, message, notes): errors with the number of notes that follow them in the same file."""
    rows = lines_of(outputs).filter(F.col("line").rlike(MYPY)).select("output_id", "line_no", F.regexp_extract("line", MYPY, 1).alias("file"), F.regexp_extract("line", MYPY, 2).cast("int").alias("at"), (F.regexp_extract("line", MYPY, 4) == "note").alias("note"), F.regexp_extract("line", MYPY, 5).alias("message"))
    rows = running(chunked(rows), block=count(~F.col("note")), head=latest(F.when(~F.col("note"), F.col("file")))).filter("block > 0")
    first = F.min_by(F.struct("file", F.col("at").alias("line"), "message"), "line_no")
    return rows.groupBy("output_id", "block").agg(first.alias("e"), F.count_if(F.col("note") & (F.col("file") == F.col("head"))).alias("notes")).select("output_id", "e.*", "notes")


def tsc(outputs: DataFrame) -> DataFrame:
    return by_pattern(lines_of(outputs), "tsc", TSC, {"file": 1, "line": 2, "col": 3, "severity": 4, "code": 5, "message": 6})


def go_build(outputs: DataFrame) -> DataFrame:
    return by_pattern(lines_of(outputs), "go", GO_BUILD, {"file": 1, "line": 2, "col": 3, "message": 4}, F.lit("error"))


def diagnostic_totals(d: DataFrame) -> DataFrame:
    return d.groupBy("output_id", "tool").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"), F.countDistinct("file").alias("files"))


def by_code(d: DataFrame) -> DataFrame:
    return d.groupBy("tool", "code").agg(F.count("*").alias("n"))


def by_file(d: DataFrame, messages: int = 3) -> DataFrame:
    """Per output and file: diagnostics, and the first messages by line, column and text."""
    w = Window.partitionBy("output_id", "file").orderBy("line", "col", "message")
    ranked = d.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy("output_id", "file"))).filter(F.col("_n") <= messages)
    return ranked.groupBy("output_id", "file").agg(F.first("_all").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_n", "message"))), lambda x: x["message"]).alias("messages"))


def go_tests(outputs: DataFrame) -> DataFrame:
    """(output_id, package, passed, failed, skipped) from NDJSON test events; other lines are skipped."""
    e = lines_of(outputs).select("output_id", F.from_json("line", "Action string, Package string, Test string, Output string").alias("e")).filter("e.Package is not null and e.Test is not null")
    return e.groupBy("output_id", F.col("e.Package").alias("package")).agg(*[F.count_if(F.col("e.Action") == a).alias(n) for a, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))])


def go_packages(outputs: DataFrame) -> DataFrame:
    """(output_id, package, packages, passed, failed, skipped, build_failures) from NDJSON test events; package is null in an output's totals.

    Events of builds belong to no package; other events without one belong to
    `unknown`. A failed build is told by a package's own failing event.
    """
    schema = "Action string, Package string, Test string, FailedBuild string"
    e = lines_of(outputs).select("output_id", F.from_json("line", schema).alias("e")).select("output_id", "e.*").filter("Action not in ('build-output', 'build-fail')")
    of_test = F.col("Test").isNotNull()
    counts = {n: F.count_if(of_test & (F.col("Action") == a)) for a, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))}
    built = F.max(((F.col("Action") == "fail") & ~of_test & F.col("FailedBuild").isNotNull()).cast("long"))
    names = ["packages", *counts, "build_failures"]
    by_package = e.groupBy("output_id", F.coalesce("Package", F.lit("unknown")).alias("package")).agg(F.lit(1).cast("long").alias("packages"), *[c.alias(n) for n, c in counts.items()], built.alias("build_failures"))
    totals = by_package.groupBy("output_id").agg(*[F.sum(n).alias(n) for n in names]).select("output_id", F.lit(None).cast("string").alias("package"), *names)
    return by_package.unionByName(totals)


def linters_and_files(d: DataFrame, most: int = 10, shown: int = 3) -> DataFrame:
    """(output_id, kind, name, n, linters, rank): the linters (codes) and the files with the most diagnostics; files with their most frequent linters. Ties go by name."""
    pairs = d.groupBy("output_id", "file", "code").agg(F.count("*").alias("n"))
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "code"))), 1, shown)
    files = pairs.groupBy("output_id", F.col("file").alias("name")).agg(F.sum("n").alias("n"), F.transform(first, lambda v: v["code"]).alias("linters"))
    linters = pairs.groupBy("output_id", F.col("code").alias("name")).agg(F.sum("n").alias("n")).withColumn("linters", F.lit(None).cast("array<string>"))
    both = files.withColumn("kind", F.lit("file")).unionByName(linters.withColumn("kind", F.lit("linter")))
    w = Window.partitionBy("output_id", "kind").orderBy(F.desc("n"), "name")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("output_id", "kind", "name", "n", "linters", "rank")


PLAYWRIGHT_FAILED = r"[×✗]\s+.*?›\s+([^›]+\.spec\.[tj]sx?)"


def playwright(outputs: DataFrame) -> DataFrame:
    """(output_id, total, passed, failed, skipped, duration_ms, failures, parse_tier): from a JSON report, else from the summary of a text.

    failures holds (test, file, error) in the report's order; the error is that
    of the first failed or timed out run of the first unexpected test. What is
    neither (null and empty texts too) has zeros and parse_tier 3.
    """
    stats = F.from_json("text", "stats struct<expected:bigint,unexpected:bigint,skipped:bigint,duration:double>")["stats"]
    o = outputs.select("output_id", text_key().alias("key"), strip_ansi(F.col("text")).alias("t"), stats.alias("stats")).join(suite_specs(outputs), "key", "left")
    o = o.withColumn("t", F.when(F.col("stats.expected").isNull(), F.coalesce("t", F.lit(""))))
    number = lambda word: F.coalesce(F.try_element_at(F.regexp_extract_all("t", F.lit(rf"(\d+)\s+{word}"), F.lit(1)), F.lit(-1)).cast("long"), F.lit(0).cast("long"))
    o = o.withColumns({"p": number("passed"), "f": number("failed"), "s": number("skipped")})
    full, said = F.col("stats.expected").isNotNull(), F.col("p") + F.col("f") + F.col("s")
    marks = F.arrays_zip(F.regexp_extract_all("t", F.lit(PLAYWRIGHT_FAILED), F.lit(0)).alias("test"), F.regexp_extract_all("t", F.lit(PLAYWRIGHT_FAILED), F.lit(1)).alias("file"))
    lasted = r"\((\d+(?:\.\d+)?)(ms|s|m)\)"
    unit = F.regexp_extract("t", lasted, 2)
    ms = F.regexp_extract("t", lasted, 1).try_cast("double") * F.when(unit == "s", 1000).when(unit == "m", 60000).otherwise(1)
    none = F.expr("cast(array() as array<struct<test:string,file:string,error:string>>)")
    return o.select(
        "output_id", F.when(full, F.coalesce("total", F.lit(0).cast("long"))).otherwise(said).alias("total"), F.when(full, F.col("stats.expected")).otherwise(F.col("p")).alias("passed"),
        F.when(full, F.col("stats.unexpected")).otherwise(F.col("f")).alias("failed"), F.when(full, F.col("stats.skipped")).otherwise(F.col("s")).alias("skipped"),
        F.when(full, F.col("stats.duration")).when(said > 0, ms).cast("long").alias("duration_ms"),
        F.when(full, F.coalesce("failures", none)).when(said > 0, F.transform(marks, lambda m: F.struct(m["test"].alias("test"), m["file"].alias("file"), F.lit("").alias("error")))).otherwise(none).alias("failures"),
        F.when(full, 1).when(said > 0, 2).otherwise(3).alias("parse_tier"),
    )


def pip_packages(outputs: DataFrame) -> DataFrame:
    """(output_id, name, current_version, latest_version) of JSON package lists."""
    x = parsed(outputs, "struct<name:string,version:string,latest_version:string>")
    return x.select("output_id", F.col("x.name").alias("name"), F.col("x.version").alias("current_version"), F.col("x.latest_version").alias("latest_version"))


def dependency_totals(deps: DataFrame) -> DataFrame:
    return deps.groupBy("output_id").agg(F.count("*").alias("packages"), F.count_if(F.col("latest_version") != F.col("current_version")).alias("outdated"))


def packages_by_letter(deps: DataFrame, most: int = 10) -> DataFrame:
    letter = F.upper(F.substring("name", 1, 1))
    w = Window.partitionBy("letter").orderBy("name")
    names = deps.select(letter.alias("letter"), "name").distinct().withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return names.groupBy("letter").agg(F.array_sort(F.collect_list("name")).alias("names"))


def diff_stat(outputs: DataFrame) -> DataFrame:
    """(output_id, file, added, removed) of unified diffs."""
    file = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1))
    rows = running(chunked(lines_of(outputs)), file=latest(file)).filter("file is not null")
    plus, minus = F.col("line").startswith("+") & ~F.col("line").startswith("+++"), F.col("line").startswith("-") & ~F.col("line").startswith("---")
    return rows.groupBy("output_id", "file").agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"))


def change_counts(outputs: DataFrame) -> DataFrame:
    """Staged, modified, untracked and conflicting files of two-letter status lines below an output's first line, which names the branch; U in front is a conflict."""
    rows = lines_of(outputs).withColumn("x", F.substring("line", 1, 1)).withColumn("y", F.substring("line", 2, 1))
    here = (F.col("line_no") > 0) & (F.octet_length("line") >= 3)
    n = lambda flag, name: F.count_if(here & flag).alias(name)
    return rows.groupBy("output_id").agg(
        n(F.col("x").isin("M", "A", "D", "R", "C"), "staged"), n(F.col("y").isin("M", "D"), "modified"), n((F.col("x") == "?") & (F.col("y") == "?"), "untracked"), n(F.col("x") == "U", "conflicts")
    )
