"""Reduction of captured outputs as work on a line table (output_id, command, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions import text as t
from thriftline.functions.json import compact_json, json_flat
from thriftline.functions.numbers import estimate_tokens
from thriftline.operators.scan import chunked, count, earlier, largest, running, since


def kept(line: Column, keep: str | None, drop: str | None) -> Column:
    """Lines of keep stay, then lines of drop go, the rest stays."""
    stays = F.lit(True) if drop is None else ~line.rlike(drop)
    return stays if keep is None else line.rlike(keep) | stays


def filtered(lines: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    return lines.filter(kept(F.col("line"), keep, drop))


def without_repeats(lines: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """Lines that differ from the last one emitted; lines of keep always stay."""
    rows = running(chunked(filtered(lines, keep, drop)), _last=earlier(F.col("line")))
    forced = F.lit(False) if keep is None else F.col("line").rlike(keep)
    return rows.filter(forced | F.col("_last").isNull() | (F.col("_last") != F.col("line"))).select(*lines.columns)


def first_occurrences(lines: DataFrame, keep: str | None = None, drop: str | None = None) -> DataFrame:
    """The first of equal lines of an output: an aggregate, so that a long output is not sorted in one task."""
    return filtered(lines, keep, drop).groupBy("output_id", "line").agg(F.min("line_no").alias("line_no"), F.first("command").alias("command")).select(*lines.columns)


def tail(lines: DataFrame, n: int, keep: str | None = None) -> DataFrame:
    """The last n lines of each output, and lines of keep before them."""
    ends = lines.groupBy("output_id").agg(F.max("line_no").alias("_end"))
    forced = F.lit(False) if keep is None else F.col("line").rlike(keep)
    return lines.join(ends, "output_id").filter((F.col("line_no") > F.col("_end") - n) | forced).drop("_end")


def head(lines: DataFrame, n: int, width: int = 120) -> DataFrame:
    """The first n lines of each output, cut to width."""
    return lines.filter(F.col("line_no") < n).withColumn("line", t.truncated(F.col("line"), width))


def error_blocks(lines: DataFrame) -> DataFrame:
    """Error lines with their continuation: indented lines and single blanks, up to two blanks in a row or any other line."""
    rows = lines.withColumn("is_error", t.is_error_line(F.col("line"))).withColumn("blank", F.trim("line") == "")
    rows = running(chunked(rows), after_blank=earlier(F.col("blank")))
    ends = F.when(F.col("blank"), F.coalesce("after_blank", F.lit(False))).otherwise(~F.col("is_error") & ~F.col("line").rlike("^[ \t]"))
    rows = running(rows, begun=largest(F.when(F.col("is_error"), F.col("line_no"))), ended=largest(F.when(ends, F.col("line_no"))))
    return rows.filter(F.col("begun").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("begun")))).select(*lines.columns)


def runs_collapsed(lines: DataFrame, important: str, limit: int) -> DataFrame:
    """Lines of important, and the first limit lines of each run between them; skipped counts the rest, on the run's last kept line."""
    rows = lines.withColumn("hit", F.col("line").rlike(important))
    rows = running(chunked(rows), run=count(F.col("hit")), n=since(~F.col("hit"), F.col("hit")))
    sizes = rows.groupBy(F.col("output_id").alias("_o"), F.col("run").alias("_r")).agg(F.count_if(~F.col("hit")).alias("size")).filter(F.col("size") > limit)
    kept = rows.filter(F.col("hit") | (F.col("n") <= limit))
    last = ~F.col("hit") & (F.col("n") == limit)
    joined = kept.join(sizes, last & F.col("output_id").eqNullSafe(F.col("_o")) & (F.col("run") == F.col("_r")), "left")
    return joined.select(*lines.columns, F.coalesce(F.col("size") - limit, F.lit(0)).cast("long").alias("skipped"))


def log_patterns(lines: DataFrame) -> DataFrame:
    """Per output, severity and normalised line: count and first raw line. No order is needed, so a hot output is summed up before it is shuffled."""
    rows = lines.withColumn("severity", t.log_severity(F.col("line"))).filter("severity is not null").withColumn("pattern", t.normalised_log_line(F.col("line")))
    return rows.groupBy("output_id", "severity", "pattern").agg(F.count("*").alias("n"), F.min_by("line", "line_no").alias("example"))


def top_log_patterns(lines: DataFrame, errors: int = 10, warnings: int = 5) -> DataFrame:
    w = Window.partitionBy("output_id", "severity").orderBy(F.desc("n"), "pattern")
    rows = log_patterns(lines).filter(F.col("severity").isin("error", "warn")).withColumn("rank", F.row_number().over(w))
    rows = rows.filter(F.col("rank") <= F.when(F.col("severity") == "error", errors).otherwise(warnings))
    return rows.withColumn("example", t.truncated(F.col("example"), 100))


def log_summary(lines: DataFrame) -> DataFrame:
    p = log_patterns(lines)
    said = []
    for s in ("error", "warn", "info"):
        here = F.col("severity") == s
        said += [F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"{s}_lines"), F.count_if(here).alias(f"{s}_patterns")]
    return p.groupBy("output_id").agg(*said)


def output_summary(lines: DataFrame) -> DataFrame:
    kind = t.line_kind(F.col("line"))
    s = lines.groupBy("output_id").agg(F.count("*").alias("lines"), F.sum(F.length("line") + 1).alias("_chars"), F.count_if(kind == "error").alias("error_lines"), F.count_if(kind == "warning").alias("warning_lines"))
    tokens = F.ceil((F.col("_chars") - 1) / 4).cast("long")
    return s.withColumn("tokens", tokens).withColumn("level", t.adaptive_level(F.col("tokens"), F.col("lines"))).withColumn("action", t.output_action(F.col("tokens"))).drop("_chars")


def word_counts(outputs: DataFrame) -> DataFrame:
    """Lines, words, bytes and characters of each output (output_id, text)."""
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return outputs.select("output_id", ends.cast("long").alias("lines"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


def with_total(counts: DataFrame) -> DataFrame:
    """word_counts, and a row with the sums, whose output_id is null; zeros where there are no outputs.

    One pass: the rows and their total are two sets of one grouping, and a row
    of zeros, whose own group goes, makes the total of nothing.
    """
    names = ("lines", "words", "bytes", "chars")
    zero = counts.sparkSession.range(1).select(F.lit(None).cast(counts.schema["output_id"].dataType).alias("output_id"), *[F.lit(0).cast("long").alias(c) for c in names], F.lit(True).alias("_none"))
    rows = counts.withColumn("_none", F.lit(False)).unionByName(zero)
    keys = [F.col("output_id"), F.col("_none")]
    grouped = rows.groupingSets([keys, []], *keys).agg(*[F.sum(c).alias(c) for c in names])
    return grouped.filter("_none is null or not _none").select("output_id", *names)


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two line tables (pair_id, line_no, line) compared line by line: added, removed, modified (character sets alike by over half), else removed and added."""
    both = left.withColumnRenamed("line", "l").join(right.withColumnRenamed("line", "r"), ["pair_id", "line_no"], "full_outer").filter(~F.col("l").eqNullSafe(F.col("r")))
    change = lambda kind, text: F.struct(F.lit(kind).alias("change"), F.col(text).alias("line"))
    alike = t.char_similarity(F.col("l"), F.col("r")) > 0.5
    changes = F.when(F.col("l").isNull(), F.array(change("added", "r"))).when(F.col("r").isNull(), F.array(change("removed", "l"))).when(alike, F.array(change("modified", "r"))).otherwise(F.array(change("removed", "l"), change("added", "r")))
    return both.select("pair_id", "line_no", F.inline(changes))


def compact_forms(outputs: DataFrame) -> DataFrame:
    """Each text (output_id, text) raw, as compact JSON and flat, with its tokens and what it saves of the raw form, at least 0 percent."""
    forms = F.array(*[F.struct(F.lit(name).alias("format"), form.alias("form")) for name, form in (("raw", F.col("text")), ("compact", compact_json(F.col("text"))), ("flat", json_flat(F.col("text"))))])
    rows = outputs.select("output_id", estimate_tokens(F.col("text")).alias("raw"), F.inline(forms)).withColumn("tokens", estimate_tokens(F.col("form")))
    return rows.select("output_id", "format", "tokens", F.when((F.col("raw") > 0) & (F.col("tokens") < F.col("raw")), 100 - F.col("tokens") * 100.0 / F.col("raw")).otherwise(0.0).alias("savings_pct"))


#: What goes from a text outside code, and a block of code with its fences.
MARKDOWN_NOISE = (r"(?s)<!--.*?-->", r"(?md)^\s*\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)\s*$", r"(?md)^\s*!\[[^\]]*\]\([^)]*\)\s*$", r"(?md)^\s*(?:---+|\*\*\*+|___+)\s*$")
FENCED = r"(?s)```[^\n]*(?:\n.*?(?:```[^\n]*\n?|\z)|\z)|~~~(?!.*```)[^\n]*(?:\n.*?(?:~~~[^\n]*\n?|\z)|\z)"


def markdown_clean(outputs: DataFrame) -> DataFrame:
    """Texts without HTML comments, lines of one badge or image, and rules; blank runs collapsed to one empty line; trimmed.

    Code between fences stays as it is, to the end of the text where a fence is
    not closed. A text has fences of ~ only where none of ` follow. Null stays null.
    """
    def cleaned(part: Column) -> Column:
        for pattern in MARKDOWN_NOISE:
            part = F.regexp_replace(part, pattern, "")
        return F.regexp_replace(part, r"\n{3,}", "\n\n")

    blocks = F.regexp_extract_all("text", F.lit(FENCED), F.lit(0))
    joined = F.zip_with(F.split("text", FENCED, -1), blocks, lambda part, block: F.concat(cleaned(part), F.coalesce(block, F.lit(""))))
    return outputs.withColumn("text", F.regexp_replace(F.array_join(joined, ""), r"^\s+|\s+\z", ""))
