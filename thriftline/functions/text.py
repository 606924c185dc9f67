"""Expressions over lines and whole outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a log line's variable parts become, in this order.
LOG_PARTS = (
    (r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*\s*", ""),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\b\d{4,}\b", "<NUM>"),
    (r"/[\w./\-]+", "<PATH>"),
)
#: How a line of an error starts or reads.
ERROR_LINES = (
    r"(?i)error[\s:\[]", r"(?i)\berr\b", r"(?i)warning[\s:\[]", r"(?i)\bwarn\b", "(?i)failed", "(?i)failure", "(?i)exception", "(?i)panic",
    r"^error\[E\d+]:", r"^\s*--> .*:\d+:\d+$", "^Traceback", r'^\s*File ".*", line \d+', r"^\s*at .*:\d+:\d+", r"\.go:\d+:",
)
ERROR_LINE = "|".join(f"(?:{p})" for p in ERROR_LINES)
#: Limits in tokens and lines of how much an output is reduced.
PASS_TOKENS, PASS_LINES, LIGHT_TOKENS, SUMMARISE_TOKENS = 500, 5, 2000, 4000
#: Words of variables whose values are masked.
SENSITIVE_WORDS = ("key", "secret", "password", "token", "credential", "auth", "private", "api_key", "apikey", "access_key", "jwt")
SENSITIVE = "|".join(SENSITIVE_WORDS)
#: Fixed value: escape sequences of terminals.
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*\x07"


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def truncated(c: Column, n: int) -> Column:
    """At most n characters, the last three of them dots where something is cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, max(0, n - 3)), F.lit("...")))


def normalised_log_line(c: Column) -> Column:
    for pattern, instead in LOG_PARTS:
        c = F.regexp_replace(c, pattern, instead)
    return F.trim(c)


def log_severity(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("error|fatal|panic"), "error").when(low.contains("warn"), "warn").when(low.contains("info"), "info")


def line_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("error|failed|fatal"), "error").when(low.contains("warn") & ~low.contains("error"), "warning")


def is_error_line(c: Column) -> Column:
    return c.rlike(ERROR_LINE)


def adaptive_level(tokens: Column, n_lines: Column) -> Column:
    return F.when((tokens <= PASS_TOKENS) | (n_lines <= PASS_LINES), "passthrough").when(tokens <= LIGHT_TOKENS, "light").otherwise("structured")


def output_action(tokens: Column, has_store: bool = False) -> Column:
    return F.when(tokens >= SUMMARISE_TOKENS, "chunk" if has_store else "summarise").otherwise("filter")


def masked(key: Column, value: Column) -> Column:
    """A value whose key sounds secret: its ends if it is long, else only stars."""
    ends = F.concat(F.substring(value, 1, 2), F.lit("****"), F.substring(value, -2, 2))
    return F.when(F.lower(key).rlike(SENSITIVE), F.when(F.length(value) > 4, ends).otherwise("****")).otherwise(value)


def text_lines(c: Column) -> Column:
    """The lines of a text, without an empty one after the last line end."""
    parts = F.split(c, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def content_type(c: Column) -> Column:
    """json, code, structured or text, by how a text and its first lines look; an empty line counts as an unchanged one."""
    rows = text_lines(c)
    head, more = F.slice(rows, 1, 50), F.slice(rows, 1, 100)
    changed = F.size(F.filter(head, lambda x: (x == "") | x.rlike("^[+ -]")))
    fields = F.size(F.filter(more, lambda x: x.contains(":") | x.contains("|")))
    return (
        F.when(c.rlike(r"^\s*[{\[]"), "json")
        .when(c.contains("@@") | c.contains("```") | (changed * 2 > F.size(head)), "code")
        .when(fields * 2 > F.size(more), "structured").otherwise("text")
    )


def output_type(command: Column, text: Column) -> Column:
    """tests, build, log, json, list or generic, by the command first and then by what the text says.

    A list has lines of ten words at least, without tabs, below 200 bytes.
    """
    cmd, low = F.lower(command), F.lower(text)
    listed = F.forall(text_lines(text), lambda x: (F.octet_length(x) < 200) & ~x.contains("\t") & (F.size(F.array_remove(F.split(x, r"\s+"), "")) >= 10))
    return (
        F.when(cmd.contains("test") | (low.contains("passed") & low.contains("failed")), "tests")
        .when(cmd.rlike("build|compile") | low.contains("compiling"), "build")
        .when(low.contains("error:") | low.contains("warn:") | low.contains("[info]"), "log")
        .when(text.rlike(r"^\s*[{\[]"), "json").when(listed, "list").otherwise("generic")
    )


def char_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets; 1 for two empty texts."""
    x, y = (F.array_remove(F.array_distinct(F.split(c, "")), "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def stripped(c: Column | str) -> Column:
    """Without blanks (space, tab to carriage return) at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
