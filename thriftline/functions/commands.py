"""Expressions over command lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENV_PREFIX = r"^(?:sudo\s+|[A-Z_][A-Z0-9_]*=\S*\s+)+"
SHELL_PREFIX = r"^(?:sudo\s+|env\s+|[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+"
RUNNER = r"^(?:(?:mise\s+(?:exec|x)\s+(?:--\s+)?|just\s+--\s+|task\s+--\s+))+"


def words(c: Column) -> Column:
    """The words between blanks."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def base_command(c: Column) -> Column:
    """First two words behind sudo and KEY=VALUE prefixes."""
    return F.array_join(F.slice(words(F.regexp_replace(F.trim(c), ENV_PREFIX, "")), 1, 2), " ")


def base_command_after_env(c: Column) -> Column:
    """First two words behind leading words with =; the command itself if none is left."""
    w = words(c)
    # the number of leading words with =: as many as all words up to there have it
    lead = F.size(F.filter(F.transform(w, lambda x, i: F.forall(F.slice(w, 1, i + 1), lambda y: y.contains("="))), lambda ok: ok))
    rest = F.slice(w, lead + 1, 2)
    return F.when(F.size(rest) == 0, c).otherwise(F.array_join(rest, " "))


def base_command_discover(c: Column) -> Column:
    """First word, with the second unless it starts with - or holds / or a dot."""
    w = words(c)
    second = F.get(w, 1)
    plain = second.isNull() | second.startswith("-") | second.contains("/") | second.contains(".")
    return F.coalesce(F.when(plain, F.get(w, 0)).otherwise(F.array_join(F.slice(w, 1, 2), " ")), F.lit(""))


def strip_env_prefix(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), SHELL_PREFIX, "")


def unwrap_runner(c: Column) -> Column:
    """The command behind `mise exec`, `just --` and `task --`."""
    return F.regexp_replace(F.trim(c), RUNNER, "")


def display_command(c: Column) -> Column:
    return F.array_join(F.slice(words(unwrap_runner(c)), 1, 2), " ")


def split_chain_text(cmd: str) -> list[str]:
    """The parts of a command between && || and ; outside quotes. A pipe, here-document or arithmetic outside quotes leaves it whole; a backslash, but in single quotes, takes the next character out of account."""
    whole = [cmd.strip()] if cmd.strip() else []
    parts, start, quote, i = [], 0, "", 0
    while i < len(cmd):
        c, two = cmd[i], cmd[i : i + 2]
        if c == "\\" and quote != "'":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif two in ("&&", "||"):
            parts.append(cmd[start:i])
            start = i + 2
            i += 1
        elif c == ";":
            parts.append(cmd[start:i])
            start = i + 1
        elif c == "|" or two == "<<" or cmd[i : i + 3] == "$((":
            return whole
        i += 1
    return [p.strip() for p in [*parts, cmd[start:]] if p.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_chain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for commands in batches:
        yield commands.map(lambda c: None if c is None else split_chain_text(c))


def tokens_similarity(a: Column, b: Column) -> Column:
    """0 for different base commands, 1 if neither has arguments, else half plus half the Jaccard similarity of the argument sets."""
    def args(c: Column) -> Column:
        w = words(F.regexp_replace(F.trim(c), ENV_PREFIX, ""))
        return F.array_distinct(F.slice(w, F.lit(3), F.size(w)))

    x, y = args(a), args(b)
    union = F.size(F.array_union(x, y))
    return F.when(base_command(a) != base_command(b), 0.0).when(union == 0, 1.0).otherwise(0.5 + 0.5 * F.size(F.array_intersect(x, y)) / union)


def path_only_difference(a: Column, b: Column) -> Column:
    sim = tokens_similarity(a, b)
    return (base_command(a) == base_command(b)) & (sim > 0.9) & (sim < 1.0)


def changed_token(wrong: Column, right: Column) -> Column:
    """The first token that only one of two commands has, by position in it."""
    gone, new = F.get(F.array_except(words(wrong), words(right)), 0), F.get(F.array_except(words(right), words(wrong)), 0)
    return (
        F.when(gone.isNotNull() & new.isNotNull(), F.concat(gone, F.lit(" → "), new))
        .when(gone.isNotNull(), F.concat(F.lit("removed "), gone)).when(new.isNotNull(), F.concat(F.lit("added "), new)).otherwise("unknown")
    )
