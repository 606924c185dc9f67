"""File inventories, tool lines and rules over outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions.paths import NOISE_NAMES
from thriftline.functions.text import text_lines
from thriftline.operators.discovery import HEAVY

INFRA_RESOURCE = r"^\s*# (\S+) (?:will be|must be) (\w+)"


def without_noise(files: DataFrame, show_all: bool = False) -> DataFrame:
    """Files (path) that are in no well-known noise folder."""
    return files if show_all else files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in NOISE_NAMES])))


def by_extension(files: DataFrame, k: int = 5) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("no ext")
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(k)


def by_folder(files: DataFrame) -> DataFrame:
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(".")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))


def budgeted(items: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """Items in the order of their groups and within them, up to a budget over all groups.

    Groups before the one where the budget ends are known from their counts, so
    only rows of groups that may be shown are sorted.
    """
    sizes = items.groupBy(group).agg(F.count("*").alias("_size"))
    first = sizes.orderBy(group).limit(budget)  # each group has an item, so no later one can be shown
    before = first.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < budget)
    rows = items.join(before, group).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return rows.filter(F.col("_before") + F.col("_n") <= budget).drop("_size", "_before", "_n")


def package_noise_gone(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    boring = (line.startswith(">") & line.contains("@")) | F.ltrim(line).startswith("npm WARN") | F.ltrim(line).startswith("npm notice") | line.contains("⸩") | line.contains("⸨") | (line.contains("...") & (F.octet_length(line) < 10)) | (F.trim(line) == "")
    return lines.filter(~boring)


def infra_changes(lines: DataFrame) -> DataFrame:
    """(output_id, line_no, address, action) of a plan's resource lines."""
    hit = lines.filter(F.col("line").rlike(INFRA_RESOURCE))
    return hit.select("output_id", "line_no", F.regexp_extract("line", INFRA_RESOURCE, 1).alias("address"), F.regexp_extract("line", INFRA_RESOURCE, 2).alias("action"))


def status_lines(lines: DataFrame) -> DataFrame:
    """Status lines without hints and blanks, up to the line that says that all is clean."""
    clean = F.min(F.when(F.col("line").contains("working tree clean"), F.col("line_no")))
    ends = lines.groupBy("output_id").agg(clean.alias("_end"))
    rows = lines.join(ends, "output_id").filter(F.col("_end").isNull() | (F.col("line_no") <= F.col("_end"))).drop("_end")
    return rows.filter((F.trim("line") != "") & ~F.ltrim("line").startswith("(use \"git"))


def matching_rule(outputs: DataFrame, rules: DataFrame) -> DataFrame:
    """outputs with the rule (priority, command and whatever else rules has) of least priority whose command theirs contains. rules is small and broadcast behind a check.

    A few commands may hold any share of the outputs, so rules of the HEAVY most
    frequent ones (no command counts as one) are broadcast, and texts stay where
    they are; only outputs of other commands are shuffled.
    """
    small = F.broadcast(rules) if rules.limit(100_001).count() <= 100_000 else rules
    counts = outputs.groupBy("command").agg(F.count("*").alias("_n"))
    best = counts.alias("c").join(small.alias("r"), F.col("c.command").contains(F.col("r.command"))).groupBy(F.col("c.command").alias("command")).agg(F.min(F.struct("r.priority", *[f"r.{c}" for c in rules.columns if c != "priority"])).alias("rule"))
    heavy = counts.orderBy(F.desc("_n"), "command").limit(HEAVY).select("command")
    same = F.col("command").eqNullSafe(F.col("_command"))
    often = outputs.join(F.broadcast(heavy.join(best, "command", "left").withColumnRenamed("command", "_command")), same).drop("_command")
    others = outputs.join(F.broadcast(heavy.withColumnRenamed("command", "_command")), same, "left_anti")
    return often.unionByName(others.join(best, "command", "left"))


def build_counts(lines: DataFrame) -> DataFrame:
    """Quick counts of a build's lines."""
    low = F.lower("line")
    return lines.groupBy("output_id").agg(
        F.count_if(low.rlike("compiling|compiled")).alias("compiled"), F.count_if(low.contains("error") & ~low.contains("0 error")).alias("errors"), F.count_if(low.contains("warning") & ~low.contains("0 warning")).alias("warnings")
    )


def suites(lines: DataFrame) -> DataFrame:
    """Sums over the result lines of several test suites."""
    pattern = r"test result: (\w+)\. (\d+) passed; (\d+) failed; (\d+) ignored"
    number = lambda i: F.regexp_extract("line", pattern, i).cast("long")
    return lines.filter(F.col("line").rlike(pattern)).groupBy("output_id").agg(F.count("*").alias("suites"), F.sum(number(2)).alias("passed"), F.sum(number(3)).alias("failed"), F.sum(number(4)).alias("ignored"))


def ci_checks(checks: DataFrame) -> DataFrame:
    """Per output: checks that passed, failed and wait, and the failed ones' names. checks: output_id, name, state."""
    kind = F.when(F.col("state").isin("pass", "success"), "passed").when(F.col("state").isin("fail", "failure"), "failed").otherwise("pending")
    return checks.groupBy("output_id").agg(*[F.count_if(kind == k).alias(k) for k in ("passed", "failed", "pending")], F.array_sort(F.collect_set(F.when(kind == "failed", F.col("name")))).alias("failed_names"))


def image_sizes(images: DataFrame) -> DataFrame:
    """Number of images (output_id, size text) and their size in MB."""
    n = F.regexp_extract("size", r"^([\d.]+)", 1).cast("double")
    mb = F.when(F.col("size").endswith("GB"), n * 1024).when(F.col("size").endswith("MB"), n).otherwise(0.0)
    return images.groupBy("output_id").agg(F.count("*").alias("images"), F.sum(mb).alias("mb"))


def validated(pairs: DataFrame) -> DataFrame:
    """Reduced outputs (raw_tokens, reduced_tokens, raw_lines, degraded) that are worth it; the others fall back to raw. Of empty ones there is nothing to save."""
    saved = 1 - F.try_divide("reduced_tokens", "raw_tokens")  # of no tokens there is no share
    back = ((F.col("reduced_tokens") == 0) & (F.col("raw_tokens") > 0)) | ((F.col("raw_tokens") > 0) & ((saved < 0.2) | (F.col("degraded") & (saved < 0.4)) | ((F.col("raw_lines") < 200) & (saved > 0.95))))
    return pairs.withColumn("status", F.when(back, "raw").otherwise("reduced")).withColumn("tokens", F.when(back, F.col("raw_tokens")).otherwise(F.col("reduced_tokens")))


def grep_hits(lines: DataFrame) -> DataFrame:
    """(output_id, file, at, text) of `file:line:text` lines."""
    p = F.split("line", ":", 3)
    return lines.filter((F.size(p) == 3) & F.get(p, 1).rlike(r"^\d+$")).select("output_id", F.get(p, 0).alias("file"), F.get(p, 1).cast("int").alias("at"), F.get(p, 2).alias("text"))


def snippet(text: Column, word: str, width: int) -> Column:
    """The trimmed text, or a window of width around the first place of word, with dots where it is cut."""
    t = F.trim(text)
    at = F.greatest(F.instr(F.lower(t), word.lower()), F.lit(1))
    start = F.greatest(F.least(at - width // 3, F.length(t) - width + 1), F.lit(1))
    cut = F.substring(t, start, F.lit(width))
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + width <= F.length(t), "...").otherwise("")))


#: What a rule of a filter file holds; command and strategy must be there.
FILTER_RULE = "origin string, command string, strategy string, max_lines int, keep_pattern string, drop_pattern string"


def filter_rules(lines: DataFrame) -> DataFrame:
    """Rules of JSON lines (line_no, value) in their order: the project's before the user's, then by line; broken lines are skipped."""
    rules = lines.select("line_no", F.from_json("value", FILTER_RULE).alias("r")).select("line_no", "r.*").filter("command is not null and strategy is not null")
    order = F.struct((F.coalesce("origin", F.lit("user")) != "project").alias("late"), "line_no")
    return rules.select(order.alias("priority"), "command", "strategy", "max_lines", "keep_pattern", "drop_pattern")


def apply_filter_rules(outputs: DataFrame, rules: DataFrame) -> DataFrame:
    """outputs (command, text) with rule, the first whose command is part of theirs, and reduced, the text by its strategy.

    A line that fits keep_pattern always stays, else one that fits drop_pattern
    goes. `truncate` keeps the last max_lines lines, `filter` drops lines,
    `group` drops lines that repeat the one before, `deduplicate` lines that
    were there before. Texts without a rule or with an unknown strategy stay as
    they are, null stays null. Patterns are Java's.
    """
    o = matching_rule(outputs, rules).withColumn("_lines", text_lines(F.col("text")))
    fits = lambda line, pattern: F.coalesce(F.rlike(line, F.col(f"rule.{pattern}")), F.lit(False))
    o = o.withColumn("_kept", F.filter("_lines", lambda x: fits(x, "keep_pattern") | ~fits(x, "drop_pattern")))
    before = F.when(F.size("_kept") > 0, F.concat(F.array(F.lit(None).cast("string")), F.slice("_kept", 1, F.size("_kept") - 1))).otherwise(F.col("_kept"))
    runs = F.filter(F.zip_with("_kept", before, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: fits(p["x"], "keep_pattern") | ~p["x"].eqNullSafe(p["y"]))
    first = F.size("_lines") - F.coalesce("rule.max_lines", F.size("_lines"))
    by = {
        "truncate": F.filter("_lines", lambda x, i: (i >= first) | fits(x, "keep_pattern")), "filter": F.col("_kept"),
        "group": F.transform(runs, lambda p: p["x"]), "deduplicate": F.array_distinct("_kept"),
    }
    reduced = F.coalesce(*[F.when(F.col("rule.strategy") == s, F.array_join(lines, "\n")) for s, lines in by.items()], F.col("text"))
    return o.withColumn("reduced", reduced).drop("_lines", "_kept")


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, ext, size, modified): all files below a folder; hidden and empty ones are left out, as Spark does. Their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1))
    return files.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
