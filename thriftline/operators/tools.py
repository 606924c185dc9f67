"""Tool outputs of several kinds, from lines (output_id, line_no, line) or texts (output_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.operators.scan import chunked, count, running

#: How lines of importance start in code, records in expanded tables, and how many of each are shown.
SIGNATURE = r"^(pub\s+)?(async\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\s+\w+"
IMPORT = r"^(use |import |from |require\(|#include)"
RECORD = r"^-\[ RECORD (\d+) \]-"
ROW_COUNT = r"^\(\d+ rows?\)$"
SHOWN_RECORDS, SHOWN_FAILURES, LAST_LINES = 20, 10, 5


def vet_issues(lines: DataFrame) -> DataFrame:
    """(output_id, line_no, issue): lines that name a place in a Go file, but those that start with #."""
    line = F.trim("line")
    return lines.filter(line.contains(".go:") & ~line.startswith("#")).select("output_id", "line_no", line.alias("issue"))


def expanded_records(lines: DataFrame) -> DataFrame:
    """(output_id, place, record, pairs, shown): records of an expanded table as key=value pairs; the first ones are shown.

    place counts an output's records from 1, record is the number in its
    header. Lines that hold no pair are skipped, as are those before a header.
    """
    line = F.trim("line")
    header = F.regexp_extract(line, RECORD, 1)
    rows = lines.filter(~line.rlike(ROW_COUNT)).withColumn("header", F.when(header != "", header))
    rows = running(chunked(rows), place=count(F.col("header").isNotNull()))
    key, value = F.trim(F.substring_index(line, "|", 1)), F.trim(F.regexp_extract(line, r"(?s)^[^|]*\|(.*)$", 1))
    pair = F.when(F.col("header").isNull() & line.contains("|"), F.struct("line_no", F.concat(key, F.lit("="), value).alias("pair")))
    found = rows.filter("place > 0").groupBy("output_id", "place").agg(F.max("header").alias("record"), F.sort_array(F.collect_list(pair)).alias("p"))
    return found.select("output_id", F.col("place").cast("long").alias("place"), "record", F.array_join(F.transform("p", lambda x: x["pair"]), " ").alias("pairs"), (F.col("place") <= SHOWN_RECORDS).alias("shown"))


def issues(outputs: DataFrame) -> DataFrame:
    """(output_id, number, title, state, author) of JSON lists of issues; a text that is no such list gives no rows."""
    items = F.from_json("text", "array<struct<number:bigint,title:string,state:string,author:struct<login:string>>>")
    whole = F.forall("items", lambda x: x["number"].isNotNull() & x["title"].isNotNull() & x["state"].isNotNull() & x["author"]["login"].isNotNull())
    rows = outputs.withColumn("items", items).filter(whole).select("output_id", F.explode("items").alias("x"))
    return rows.select("output_id", "x.number", "x.title", "x.state", F.col("x.author.login").alias("author"))


def compose_builds(lines: DataFrame) -> DataFrame:
    """(output_id, summary, services, steps) of image builds: the finished line or else the first one about building, services by first mention, steps."""
    line = F.trim("line")
    at = F.struct("line_no", line.alias("line"))
    building = line.contains("Building")
    totals = lines.groupBy("output_id").agg(
        F.min(F.when(building & line.contains("FINISHED"), at)).alias("finished"), F.min(F.when(building, at)).alias("begun"), F.count_if(line.startswith("=> ")).alias("steps"),
    )
    name = F.regexp_extract("line", r"\[\s*([^\]\s]+)[^\]]*\]", 1)
    first = lines.withColumn("service", name).filter("service not in ('', '+')").groupBy("output_id", "service").agg(F.min("line_no").alias("at"))
    services = first.groupBy("output_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "service"))), lambda x: x["service"]).alias("services"))
    out = totals.join(services, "output_id", "left")
    return out.select("output_id", F.coalesce("finished.line", "begun.line").alias("summary"), F.coalesce("services", F.array().cast("array<string>")).alias("services"), "steps")


def pip_outdated(outputs: DataFrame) -> DataFrame:
    """(output_id, name, version, latest) of JSON lists; a missing latest version is unknown, other texts give no rows."""
    rows = outputs.select("output_id", F.explode(F.from_json("text", "array<struct<name:string,version:string,latest_version:string>>")).alias("x"))
    return rows.select("output_id", "x.name", "x.version", F.coalesce("x.latest_version", F.lit("unknown")).alias("latest"))


def _any(c: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def test_summary(lines: DataFrame) -> DataFrame:
    """(output_id, section, line_no, line, n_failures) of test runs (command, lines), by the runner that the command names.

    section is `failures` (the first ten), `summary` (the runner's result
    lines), or, for an output without these, `output`: its last five lines but
    blank ones. "cargo test" names two runners, as it holds "go test"; a line
    that both take counts once.
    """
    cmd, line = F.col("command"), F.col("line")
    cargo, pytest, go = cmd.contains("cargo test"), cmd.contains("pytest"), cmd.contains("go test")
    jest = _any(cmd, "jest", "npm test", "yarn test")
    result = (
        (cargo & line.contains("test result:")) | (pytest & _any(line, " passed", " failed", " error")) | (jest & _any(line, "Tests:", "Test Suites:"))
        | (go & (line.startswith("ok") | line.startswith("FAIL") | line.startswith("---")))
    )
    failed = (cargo & line.contains("FAILED") & ~line.contains("test result")) | (pytest & line.contains("FAILED")) | (jest & _any(line, "✕", "FAIL")) | (go & line.contains("FAIL"))
    rows = lines.select("output_id", "line_no", "line", result.alias("is_result"), failed.alias("is_failure"))
    totals = rows.groupBy("output_id").agg(F.count_if("is_failure").alias("n_failures"), F.count_if("is_result").alias("n_results"), F.max("line_no").alias("last"))
    failures = rows.filter("is_failure").withColumn("n", F.row_number().over(Window.partitionBy("output_id").orderBy("line_no"))).filter(F.col("n") <= SHOWN_FAILURES)
    last = rows.join(totals.filter("n_results = 0").select("output_id", "last"), "output_id").filter((F.col("line_no") > F.col("last") - LAST_LINES) & (F.trim("line") != ""))
    parts = [(failures, "failures"), (rows.filter("is_result"), "summary"), (last, "output")]
    out = None
    for df, section in parts:
        df = df.select("output_id", F.lit(section).alias("section"), "line_no", "line")
        out = df if out is None else out.unionByName(df)
    return out.join(totals.select("output_id", "n_failures"), "output_id")


def smart_truncate(lines: DataFrame, max_lines: int) -> DataFrame:
    """(output_id, line_no, sub, line): code cut to about max_lines lines, with notes on what is left out.

    The first half of the limit stays as it is. After it lines of importance
    stay (definitions, imports, what is public or exported, lone braces) until
    one less than the limit are kept. A note (sub 0) stands before a kept line
    (sub 1) where some were left out, and at the end (line_no after the last).
    """
    line, half = F.trim("line"), max_lines // 2
    important = line.rlike(SIGNATURE) | line.rlike(IMPORT) | line.startswith("pub ") | line.startswith("export ") | line.isin("{", "}")
    order = Window.partitionBy("output_id").orderBy("line_no")  # of kept lines only
    rows = running(chunked(lines.withColumn("important", important)), at=count(F.lit(True)))
    rows = running(rows.withColumn("later", (F.col("at") > half) & F.col("important")), rank=count(F.col("later")))
    sizes = lines.groupBy(F.col("output_id").alias("_o")).agg(F.count("*").alias("total"))
    rows = rows.join(sizes, F.col("output_id").eqNullSafe(F.col("_o")))
    short = F.col("total") <= max_lines
    kept = rows.filter(short | (F.col("at") <= half) | (F.col("later") & (F.col("rank") <= max_lines - 1 - half)))
    gap = F.when(~short, F.col("at") - F.coalesce(F.lag("at").over(order), F.lit(0)) - 1).otherwise(0)
    kept = kept.withColumn("gap", gap)
    note = F.when(F.col("gap") > 0, F.concat(F.lit("    // ... "), F.col("gap"), F.lit(" lines omitted")))
    body = kept.select("output_id", "line_no", F.posexplode(F.array(note, "line")).alias("sub", "line")).filter("line is not null")
    ends = kept.filter(~short).groupBy("output_id").agg(F.max("total").alias("total"), (F.count("*") + F.count_if(F.col("gap") > 0)).alias("n"), F.max("line_no").alias("line_no"))
    end = F.concat(F.lit("// ... "), F.col("total") - F.col("n"), F.lit(" more lines (total: "), F.col("total"), F.lit(")"))
    return body.unionByName(ends.select("output_id", (F.col("line_no") + 1).alias("line_no"), F.lit(2).alias("sub"), end.alias("line")))
