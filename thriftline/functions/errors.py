"""Classes of failed commands by their output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of error classes, tried in this order, without regard to case.
ERROR_CLASSES = (
    ("Unknown Flag", "(unexpected argument|unknown (option|flag)|unrecognized (option|flag)|invalid (option|flag))"),
    ("Command Not Found", "(command not found|not recognized as an internal|no such file or directory.*command)"),
    ("Missing Argument", "(requires a value|requires an argument|missing (required )?argument|expected.*argument)"),
    ("Permission Denied", "(permission denied|access denied|not permitted)"),
    ("Wrong Path", "(no such file or directory|cannot find the path|file not found)"),
)
#: Fixed value: how a user's own refusal reads.
REJECTED = "(user (doesn't want|declined|rejected|cancelled)|operation (cancelled|aborted) by user)"
#: Words of a real error, any of them.
ERROR_WORDS = ("error", "failed", "unknown", "invalid", "not found", "permission denied", "cannot")
#: Texts of compile and test cycles, any of them.
CYCLE_TEXTS = (
    "error[E", "aborting due to", "test result: FAILED", "short test summary info", "Traceback (most recent call last)", "SyntaxError:",
    "IndentationError:", "NameError:", "TypeError:", "AttributeError:", "npm ERR! Test failed", "ERR_PNPM_RECURSIVE_FAIL", "--- FAIL:",
)


def any_of(c: Column, texts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in texts])


def is_command_error(is_error: Column, output: Column) -> Column:
    """Flagged, not refused by the user, and worded like an error."""
    return is_error & ~output.rlike(f"(?i){REJECTED}") & any_of(F.lower(output), ERROR_WORDS)


def error_class(output: Column) -> Column:
    first = F.lit("General Error")
    for name, pattern in reversed(ERROR_CLASSES):
        first = F.when(output.rlike(f"(?i){pattern}"), name).otherwise(first)
    return first


def is_cycle_error(output: Column) -> Column:
    """An error of a compile or test cycle, which no other command line would fix."""
    return (
        any_of(output, CYCLE_TEXTS)
        | (output.contains("FAILED ") & output.contains("::"))
        | (any_of(output, ("FAIL ", "Tests failed:")) & any_of(output, (".test.", ".spec.")))
        | (output.contains("FAIL\t") & output.contains("---"))
    )
