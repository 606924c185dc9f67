"""Tool outputs with sections and blocks, as values that run along a line table (output_id, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.operators.scan import chunked, count, largest, latest, running, since


def group(pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))


RUST_HEAD = r"^(error|warning)(?:\[(\w+)\])?: (.+)$"
RUST_PLACE = r"^\s*--> (.+?):(\d+):(\d+)"


def rust_blocks(lines: DataFrame, tool: str) -> DataFrame:
    """Diagnostics of blocks that a header opens and a place line completes; blocks without a place are summaries and go."""
    rows = running(chunked(lines.withColumn("head", F.col("line").rlike(RUST_HEAD))), block=count(F.col("head"))).filter("block > 0")
    first = lambda c: F.first(c, ignorenulls=True)
    place = F.when(F.col("line").rlike(RUST_PLACE), F.struct("line_no", group(RUST_PLACE, 1).alias("file"), group(RUST_PLACE, 2).cast("int").alias("line"), group(RUST_PLACE, 3).cast("int").alias("col")))
    head = F.when(F.col("head"), F.struct(group(RUST_HEAD, 1).alias("severity"), group(RUST_HEAD, 2).alias("code"), group(RUST_HEAD, 3).alias("message")))
    blocks = rows.groupBy("output_id", "block").agg(first(head).alias("h"), F.min(place).alias("p")).filter("p is not null")
    return blocks.select("output_id", F.lit(tool).alias("tool"), "p.file", "p.line", "p.col", "h.severity", "h.code", "h.message")


def lint_rules(diagnostics: DataFrame, samples: int = 3, k: int = 15) -> DataFrame:
    """Per lint message: occurrences and its first places, the k most frequent of each output."""
    at = F.concat_ws(":", "file", "line")
    w = Window.partitionBy("output_id", "message").orderBy("file", "line", "col")
    ranked = diagnostics.withColumn("_n", F.row_number().over(w))
    rules = ranked.groupBy("output_id", "message").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= samples, F.struct("_n", at.alias("at"))))), lambda x: x["at"]).alias("places"))
    return rules.withColumn("rank", F.row_number().over(Window.partitionBy("output_id").orderBy(F.desc("n"), "message"))).filter(F.col("rank") <= k)


PYTEST_SUMMARY = r"^=+ .*\b(?:passed|failed|skipped|error)"


def pytest_results(lines: DataFrame) -> DataFrame:
    """(output_id, passed, failed, skipped) of the last summary line of each output."""
    number = lambda word: F.coalesce(F.nullif(F.regexp_extract("line", rf"(\d+) {word}", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    rows = lines.filter(F.col("line").rlike(PYTEST_SUMMARY))
    return rows.groupBy("output_id").agg(F.max_by(F.struct(*[number(w).alias(w) for w in ("passed", "failed", "skipped")]), "line_no").alias("s")).select("output_id", "s.*")


def pytest_failures(lines: DataFrame) -> DataFrame:
    """(output_id, test_name, error_message) of `FAILED name - message` lines in the summary section, which the last === header opens."""
    rows = running(chunked(lines), section=latest(F.when(F.col("line").startswith("==="), F.col("line")))).filter(F.col("section").contains("short test summary") & F.col("line").startswith("FAILED "))
    p = r"^FAILED (\S+)(?: - (.*))?$"
    return rows.select("output_id", group(p, 1).alias("test_name"), group(p, 2).alias("error_message"))


NEXTEST = r"^\s*(PASS|FAIL) \[\s*([\d.]+)s\] (\S+) (\S+)"


def nextest_results(lines: DataFrame) -> DataFrame:
    """(output_id, passed, failed, seconds) of PASS and FAIL lines; a test that is reported again counts once."""
    rows = lines.filter(F.col("line").rlike(NEXTEST)).select("output_id", group(NEXTEST, 1).alias("state"), group(NEXTEST, 2).cast("double").alias("s"), F.concat_ws("::", group(NEXTEST, 3), group(NEXTEST, 4)).alias("test"))
    one = rows.groupBy("output_id", "test").agg(F.min("state").alias("state"), F.max("s").alias("s"))  # FAIL sorts before PASS
    return one.groupBy("output_id").agg(F.count_if(F.col("state") == "PASS").alias("passed"), F.count_if(F.col("state") == "FAIL").alias("failed"), F.round(F.sum("s"), 3).alias("seconds"))


def unformatted(lines: DataFrame) -> DataFrame:
    """(output_id, tool, file) of files that a formatter would change."""
    tools = (("ruff", r"^Would reformat: (.+)$"), ("black", r"^would reformat (.+)$"), ("prettier", r"^\[warn\] (\S+\.\w+)$"))
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(t).alias("tool"), F.regexp_extract("line", p, 1).alias("file"))) for t, p in tools]))
    return lines.select("output_id", F.inline(hit)).distinct()


def hunks_cut(lines: DataFrame, per_hunk: int, in_all: int) -> DataFrame:
    """Lines of unified diffs: headers, and of each hunk the first lines from its first change on, up to a number per hunk and in all."""
    rows = lines.withColumn("opens", F.col("line").startswith("@@")).withColumn("header", F.col("line").rlike(r"^(@@|diff |--- |\+\+\+ )"))
    at = lambda flag: largest(F.when(flag, F.col("line_no")))
    rows = running(chunked(rows), opened=at(F.col("opens")), changed=at(F.col("line").rlike(r"^[+-](?![+-]{2} )")))
    rows = rows.withColumn("body", F.coalesce(~F.col("header") & (F.col("changed") > F.col("opened")), F.lit(False)))
    rows = running(rows, n=since(F.col("body").cast("int"), F.col("opens")))
    rows = rows.withColumn("kept", F.col("header") | (F.col("body") & (F.col("n") <= per_hunk)))
    return running(rows, shown=count(F.col("kept"))).filter(F.col("kept") & (F.col("shown") <= in_all)).select(*lines.columns)


def psql_rows(lines: DataFrame, most: int = 30) -> DataFrame:
    """(output_id, row_no, cells) of printed tables, without rules and row counts."""
    rows = lines.filter(F.col("line").contains("|") & ~F.col("line").rlike(r"^[-+\s]+$"))
    # a rank's limit is pruned before rows are shuffled
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("output_id").orderBy("line_no"))).filter(F.col("rank") <= most + 1)
    return rows.select("output_id", (F.col("rank") - 1).alias("row_no"), F.transform(F.split("line", r"\|"), lambda c: F.trim(c)).alias("cells"))


def pods(outputs: DataFrame) -> DataFrame:
    """(output_id, name, phase, restarts, issue) of JSON lists of pods; issue: neither running nor done. Texts that are no such list give no rows."""
    schema = "items array<struct<metadata:struct<name:string>,status:struct<phase:string,containerStatuses:array<struct<restartCount:long>>>>>"
    p = outputs.select("output_id", F.explode(F.from_json("text", schema)["items"]).alias("p"))
    restarts = F.aggregate(F.coalesce("p.status.containerStatuses", F.array()), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["restartCount"], F.lit(0)))
    issue = ~F.coalesce(F.col("p.status.phase").isin("Running", "Succeeded"), F.lit(False))
    return p.select("output_id", F.col("p.metadata.name").alias("name"), F.col("p.status.phase").alias("phase"), restarts.alias("restarts"), issue.alias("issue"))


def pod_counts(rows: DataFrame) -> DataFrame:
    """Per output: pods by phase, restarts in all, and the names of all that are not well."""
    return rows.groupBy("output_id").agg(*[F.count_if(F.col("phase") == x).alias(x.lower()) for x in ("Running", "Pending", "Failed")], F.sum("restarts").alias("restarts"), F.array_sort(F.collect_list(F.when(F.col("issue"), F.coalesce("name", F.lit("-"))))).alias("issues"))


def ci_runs(outputs: DataFrame) -> DataFrame:
    """(output_id, name, status, conclusion) of JSON lists of runs."""
    x = outputs.select("output_id", F.explode(F.from_json("text", "array<struct<name:string,status:string,conclusion:string>>")).alias("x"))
    return x.select("output_id", "x.*")


def usage_periods(outputs: DataFrame) -> DataFrame:
    """(granularity, key, tokens, cost) of usage reports (text); missing cache counts are 0."""
    period = "struct<date:string,week:string,month:string,inputTokens:long,outputTokens:long,cacheCreationTokens:long,cacheReadTokens:long,totalTokens:long,totalCost:double>"
    j = F.from_json("text", f"daily array<{period}>, weekly array<{period}>, monthly array<{period}>")
    rows = outputs.select(F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), j[g].alias("p")) for g in ("daily", "weekly", "monthly")])).alias("r")).select("r.granularity", F.explode("r.p").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        "granularity", F.coalesce("p.date", "p.week", "p.month").alias("key"), F.col("p.inputTokens").alias("input_tokens"), F.col("p.outputTokens").alias("output_tokens"),
        zero("p.cacheCreationTokens").alias("cache_creation_tokens"), zero("p.cacheReadTokens").alias("cache_read_tokens"), F.col("p.totalTokens").alias("total_tokens"), F.col("p.totalCost").alias("total_cost"),
    )
