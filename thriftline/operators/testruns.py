"""Test runs: results, and for each failure its name and what was said about it, from lines (output_id, line_no, line) or texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions.text import strip_ansi, stripped
from thriftline.operators.scan import chunked, count, largest, latest, running

#: Lines of noise, frames that are internal, and the forms of summaries.
BUILD_NOISE = r"^\s*(?:Compiling|Downloading|Downloaded|Finished)"
NEXTEST_NOISE = r"^\s*(?:Compiling|Downloading|Downloaded|Finished|Locking|Updating|────|Starting|Cancelling|Canceling|Nextest run ID)"
INTERNAL_FRAME = r"/rustc/|std::|<core::"
NEXTEST_SUMMARY = r"Summary \[\s*([\d.]+)s\]\s+(\d+) tests? run:\s+(\d+) passed(?:,\s+(\d+) failed)?(?:,\s+(\d+) skipped)?"
PYTEST_RELEVANT = 3
VITEST_TESTS, VITEST_DURATION = r"Tests\s+(?:(\d+)\s+failed\s+\|\s+)?(\d+)\s+passed", r"Duration\s+([\d.]+)(ms|s)"


def _in_order(e: Column) -> Column:
    """The texts of (line_no, t) structs as one list in the order of lines; null ones go."""
    return F.transform(F.sort_array(F.collect_list(e)), lambda x: x["t"])


def _number(c: Column, pattern: str, i: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def pytest_blocks(lines: DataFrame) -> DataFrame:
    """(output_id, place, name, message, location, relevant): failure blocks of pytest runs.

    A block begins with a line of ___ name ___ between the FAILURES header and
    the short summary. message is its first E line, location the first file and
    line in it, relevant the first three lines that show what went wrong.
    """
    rows = lines.withColumn("said", stripped("line"))
    header = F.col("said").startswith("===")
    state = F.when(header & F.col("said").contains("FAILURES"), "failures").when(header & (F.col("said").contains("test session starts") | F.col("said").contains("short test summary")), "other")
    rows = running(chunked(rows), state=latest(state), place=count(F.col("said").startswith("___") & ~header))
    rows = rows.filter((F.col("state") == "failures") & ~header & (F.col("said") != "")).filter("place > 0")
    opens, low = F.col("said").startswith("___"), F.lower("said")
    telling = ~opens & (F.col("said").startswith(">") | F.col("said").startswith("E") | low.contains("assert") | low.contains("error") | F.col("said").contains(".py:"))
    t = F.col("said").alias("t")
    at = r"^(\S+\.py:\d+)"
    blocks = rows.groupBy("output_id", "place").agg(
        F.max(F.when(opens, stripped(F.btrim("said", F.lit("_"))))).alias("name"), F.min(F.when(~opens & F.col("said").rlike(r"^E\s"), F.struct("line_no", stripped(F.regexp_replace("said", r"^E\s+", "")).alias("t")))).alias("m"),
        F.min(F.when(~opens & F.col("said").rlike(at), F.struct("line_no", F.regexp_extract("said", at, 1).alias("t")))).alias("l"), F.slice(_in_order(F.when(telling, F.struct("line_no", t))), 1, PYTEST_RELEVANT).alias("relevant"),
    )
    return blocks.filter("name is not null").select("output_id", "place", "name", F.col("m.t").alias("message"), F.col("l.t").alias("location"), "relevant")


def without_internal_frames(lines: DataFrame, group: str) -> DataFrame:
    """lines (group, line_no, line) with each run of internal frames as one line that counts them, at the place of the first."""
    rows = lines.withColumn("internal", F.col("line").rlike(INTERNAL_FRAME))
    rows = running(chunked(rows, group), run=count(~F.col("internal")))
    runs = rows.filter("internal").groupBy(group, "run").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    told = runs.select(group, "line_no", F.concat(F.lit("   ... ("), F.col("n"), F.lit(" internal frames)")).alias("line"))
    return rows.filter("not internal").select(group, "line_no", "line").unionByName(told)


def cargo_blocks(lines: DataFrame) -> DataFrame:
    """(output_id, place, name, body): failure blocks of cargo test runs, between `failures:` and the result, parted by blank lines.

    name is a block's first line, body the others with internal frames collapsed.
    """
    rows = lines.filter(~F.col("line").rlike(BUILD_NOISE) & ~F.col("line").startswith("running ") & ~(F.col("line").startswith("test ") & F.col("line").endswith("... ok")))
    at = lambda flag: largest(F.when(flag, F.col("line_no")))
    # a blank line parts blocks unless it is indented by four or more
    parts = (stripped("line") == "") & ~F.col("line").startswith("    ")
    rows = running(chunked(rows), opened=at(F.col("line") == "failures:"), ended=at(F.col("line").startswith("test result:")), place=count(parts | F.col("line").startswith("test result:")))
    inside = F.col("opened").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("opened"))) & (F.col("line") != "failures:") & ~parts
    # a second failures: line alone starts no new block
    body = rows.filter(inside).withColumn("block", F.struct("output_id", "place"))
    clean = without_internal_frames(body.select("block", "line_no", "line"), "block")
    blocks = clean.groupBy("block").agg(_in_order(F.struct("line_no", F.col("line").alias("t"))).alias("b"))
    return blocks.select("block.output_id", "block.place", F.get("b", F.lit(0)).alias("name"), F.array_join(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), "\n").alias("body"))


def nextest_blocks(lines: DataFrame) -> DataFrame:
    """(output_id, place, name, body): FAIL lines of nextest runs with the lines below them, to the next PASS or FAIL line or the summary."""
    rows = lines.withColumn("said", stripped("line")).filter(~F.col("line").rlike(NEXTEST_NOISE))
    fail = F.col("said").startswith("FAIL")
    mark = F.when(fail, "fail").when(F.col("said").startswith("PASS"), "pass").when(F.col("said").startswith("Summary"), "over")
    rows = running(chunked(rows), state=latest(mark), place=count(fail), over=count(F.col("said").startswith("Summary")))
    rows = rows.filter((F.col("state") == "fail") & (F.col("over") == 0))
    body = _in_order(F.when(~fail, F.struct("line_no", F.col("line").alias("t"))))
    return rows.groupBy("output_id", "place").agg(F.max(F.when(fail, F.col("said"))).alias("name"), F.array_join(body, "\n").alias("body"))


def nextest_summary(lines: DataFrame) -> DataFrame:
    """(output_id, seconds, run, passed, failed, skipped) of the first summary line of each run."""
    rows = lines.filter(stripped("line").startswith("Summary") & F.col("line").rlike(NEXTEST_SUMMARY))
    first = rows.groupBy("output_id").agg(F.min_by("line", "line_no").alias("line"))
    n = lambda i: _number(F.col("line"), NEXTEST_SUMMARY, i)
    return first.select("output_id", F.regexp_extract("line", NEXTEST_SUMMARY, 1).cast("double").alias("seconds"), n(2).alias("run"), n(3).alias("passed"), n(4).alias("failed"), n(5).alias("skipped"))


def balanced_object(text: str | None) -> str | None:
    """The JSON object of a test report inside a text: from the brace before numTotalTests, else from the first line that starts with one, to the brace that closes it."""
    if text is None:
        return None
    mark = text.find('"numTotalTests"')
    if mark >= 0:
        start = max(text.rfind("{", 0, mark), 0)
    else:
        start, at = -1, 0
        for line in text.split("\n"):
            if line.strip().startswith("{"):
                start = at + line.index("{")
                break
            at += len(line) + 1
        if start < 0:
            return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def vitest(outputs: DataFrame) -> DataFrame:
    """(output_id, total, passed, failed, skipped, duration_ms, failures, passed_names, parse_tier) of test reports (output_id, text).

    Tier 1 is a JSON report, alone or behind a banner; tier 2 the summary of a
    text, whose failures are marked lines with the indented ones below them;
    what is neither (null and empty texts too) has zeros and tier 3. failures
    holds (test, file, error).
    """
    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([balanced_object(t) for t in texts], dtype=object)

    test = "struct<fullName:string,status:string,failureMessages:array<string>>"
    report = f"numTotalTests bigint, numPassedTests bigint, numFailedTests bigint, numPendingTests bigint, startTime bigint, endTime bigint, testResults array<struct<name:string,assertionResults:array<{test}>>>"
    whole = lambda c: F.when(c["numTotalTests"].isNotNull() & c["numPassedTests"].isNotNull() & c["numFailedTests"].isNotNull(), c)
    o = outputs.select("output_id", F.col("text"), F.from_json("text", report).alias("a"))
    o = o.withColumn("j", F.coalesce(whole(F.col("a")), whole(F.from_json(found(F.when(whole(F.col("a")).isNull(), F.col("text"))), report))))
    o = o.withColumn("t", F.when(F.col("j").isNull(), strip_ansi(F.coalesce("text", F.lit("")))))
    tests = F.flatten(F.transform(F.coalesce("j.testResults", F.array().cast(f"array<struct<name:string,assertionResults:array<{test}>>>")), lambda f: F.transform(f["assertionResults"], lambda x: F.struct(f["name"].alias("file"), x.alias("x")))))
    of_json = F.transform(F.filter(tests, lambda v: v["x"]["status"] == "failed"), lambda v: F.struct(v["x"]["fullName"].alias("test"), v["file"].alias("file"), F.array_join(v["x"]["failureMessages"], "\n").alias("error")))
    names = F.transform(F.filter(tests, lambda v: v["x"]["status"] == "passed"), lambda v: v["x"]["fullName"])
    blocks = F.regexp_extract_all("t", F.lit(r"(?m)^([^\n]*(?:✗|FAIL)[^\n]*(?:\n  [^\n]*)*)"), F.lit(1))
    rest = lambda b: F.transform(F.slice(F.split(b, "\n"), F.lit(2), F.greatest(F.size(F.split(b, "\n")) - 1, F.lit(0))), lambda x: stripped(x))
    of_text = F.transform(blocks, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("test"), F.lit("").alias("file"), F.array_join(rest(b), "\n").alias("error")))
    p, f = _number(F.col("t"), VITEST_TESTS, 2), _number(F.col("t"), VITEST_TESTS, 1)
    lasted = F.regexp_extract("t", VITEST_DURATION, 1).try_cast("double") * F.when(F.regexp_extract("t", VITEST_DURATION, 2) == "s", 1000).otherwise(1)
    full, said = F.col("j").isNotNull(), p + f > 0
    zero = F.lit(0).cast("bigint")
    none = F.expr("cast(array() as array<struct<test:string,file:string,error:string>>)")
    pick = lambda a, b, c: F.when(full, a).when(said, b).otherwise(c)
    return o.select(
        "output_id", pick(F.col("j.numTotalTests"), p + f, zero).alias("total"), pick(F.col("j.numPassedTests"), p, zero).alias("passed"), pick(F.col("j.numFailedTests"), f, zero).alias("failed"),
        pick(F.coalesce("j.numPendingTests", zero), zero, zero).alias("skipped"), pick(F.greatest(F.col("j.endTime") - F.col("j.startTime"), zero) + F.col("j.startTime") * 0, lasted.cast("bigint"), F.lit(None).cast("bigint")).alias("duration_ms"),
        pick(of_json, of_text, none).alias("failures"), pick(names, F.array().cast("array<string>"), F.array().cast("array<string>")).alias("passed_names"), pick(F.lit(1), F.lit(2), F.lit(3)).alias("parse_tier"),
    )


def quick_tests(lines: DataFrame, shown: int = 5, width: int = 70) -> DataFrame:
    """(output_id, passed, failed, skipped, failures) of test runs of any tool.

    The number before the last mention of a word counts; a line that tells of
    success without a number adds one to it. failures are the first lines that
    mention one, but `0 failed`.
    """
    low = F.lower("line")
    has = lambda *words: F.coalesce(_any_of(low, words), F.lit(False))
    number = lambda word: F.when(low.contains(word), F.nullif(F.regexp_extract(F.substring_index(low, word, 1), r"([0-9]+)\s*$", 1), F.lit("")).try_cast("bigint"))
    rows = lines.select("output_id", "line_no", "line", has("passed", "✓", "ok").alias("ok"), has("failed", "✗", "fail").alias("bad"), has("skipped", "ignored").alias("left"), number("passed").alias("p"), number("failed").alias("f"), F.coalesce(number("skipped"), number("ignored")).alias("s"))
    rows = running(chunked(rows), numbered=largest(F.when(F.col("ok") & F.col("p").isNotNull(), F.col("line_no"))), plain=count(F.col("ok") & F.col("p").isNull()))
    last = lambda c, when: F.coalesce(F.max_by(F.when(when, F.col(c)), F.when(when & F.col(c).isNotNull(), F.col("line_no"))), F.lit(0).cast("bigint"))
    # lines without a number since the last number: all of them less those up to it
    until = F.max_by("plain", F.when(F.col("line_no") == F.col("numbered"), F.col("line_no")))
    told = F.struct("line_no", F.when(F.length("line") > width, F.concat(F.substring("line", 1, width - 3), F.lit("..."))).otherwise(F.col("line")).alias("t"))
    rows = running(rows, nth=count(F.col("bad") & ~F.col("line").contains("0 failed")))
    failures = _in_order(F.when(F.col("bad") & ~F.col("line").contains("0 failed") & (F.col("nth") <= shown), told))
    return rows.groupBy("output_id").agg((last("p", F.col("ok")) + F.max("plain") - F.coalesce(until, F.lit(0))).alias("passed"), last("f", F.col("bad")).alias("failed"), last("s", F.col("left")).alias("skipped"), failures.alias("failures"))


def _any_of(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


GO_EVENT = "Action string, Package string, Test string, Output string"


def go_events(lines: DataFrame, schema: str = GO_EVENT) -> DataFrame:
    """Test events of NDJSON lines: output_id, line_no and the fields of schema; lines that are no event are skipped."""
    e = lines.filter(stripped("line").startswith("{")).select("output_id", "line_no", F.from_json("line", schema).alias("e")).filter("e.Action is not null")
    return e.select("output_id", "line_no", "e.*")


def failed_test_output(events: DataFrame) -> DataFrame:
    """(output_id, package, test, nth, output): for each failure of a test what it said before, since the failure before that; line ends are trimmed.

    Events without a package belong to `unknown`; what a test says after its
    last failure belongs to none.
    """
    e = events.filter("Test is not null").withColumn("k", F.struct("output_id", F.coalesce("Package", F.lit("unknown")).alias("package"), F.col("Test").alias("test")))
    fails = F.col("Action") == "fail"
    rows = running(chunked(e, "k"), fails=count(fails)).withColumn("nth", F.col("fails") - fails.cast("int"))
    said = F.when((F.col("Action") == "output") & F.col("Output").isNotNull(), F.struct("line_no", F.regexp_replace("Output", r"\s+\z", "").alias("t")))
    blocks = rows.groupBy("k", "nth").agg(F.max(fails).alias("failed"), _in_order(said).alias("output")).filter("failed")
    return blocks.select("k.*", (F.col("nth") + 1).alias("nth"), "output")


def build_errors(events: DataFrame) -> DataFrame:
    """(output_id, package, errors) of packages whose build failed (FailedBuild), with the distinct errors of their import path."""
    failed = events.filter("FailedBuild is not null").select("output_id", F.col("FailedBuild").alias("package")).distinct()
    errors = events.filter("Action = 'build-output'").groupBy("output_id", F.col("ImportPath").alias("package")).agg(F.countDistinct("Output").alias("errors"))
    return failed.join(errors, ["output_id", "package"], "left").na.fill(0, ["errors"])


CARGO_TEST = r"^test (\S+) \.\.\. (ok|FAILED)$"


def cargo_tests(lines: DataFrame) -> DataFrame:
    """(output_id, name, passed) of `test name ... ok` and FAILED lines."""
    rows = lines.filter(F.col("line").rlike(CARGO_TEST))
    return rows.select("output_id", F.regexp_extract("line", CARGO_TEST, 1).alias("name"), (F.regexp_extract("line", CARGO_TEST, 2) == "ok").alias("passed"))
