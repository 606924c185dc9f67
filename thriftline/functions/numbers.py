"""Token, saving and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """One token for each four characters, rounded up; 0 for an empty text."""
    return F.ceil(F.length(text) / 4).cast("long")


def saved_tokens(tokens_in: Column, tokens_out: Column) -> Column:
    return F.greatest(tokens_in - tokens_out, F.lit(0)).cast("long")


def share_pct(part: Column, whole: Column) -> Column:
    """part as a percentage of whole; 0 where whole is not positive."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def compare_savings(raw: Column, reduced: Column) -> tuple[Column, Column]:
    """Saved tokens and percentage of a pair; (0, 0) if the output grew."""
    shrank = (raw > 0) & (reduced <= raw)
    return F.when(shrank, raw - reduced).otherwise(0).cast("long"), F.when(shrank, (raw - reduced) * 100.0 / raw).otherwise(0.0)


def fixed(x: Column, places: int) -> Column:
    """x with so many places, rounded by its exact binary value, half to even."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def format_tokens(n: Column) -> Column:
    """1.2M, 3.4K or the plain number."""
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1000, F.concat(fixed(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("string"))


def format_usd(x: Column) -> Column:
    """Four places under one cent, else two."""
    return F.when(F.isnan(x) | x.isNull(), "$0.00").when(x >= 0.01, F.concat(F.lit("$"), fixed(x, 2))).otherwise(F.concat(F.lit("$"), fixed(x, 4)))


def format_duration(ms: Column) -> Column:
    """ms under a second, then seconds with one place, then minutes and seconds."""
    minutes, seconds = F.floor(ms / 60000), F.floor((ms % 60000) / 1000)
    return F.when(ms < 1000, F.format_string("%dms", ms)).when(ms < 60000, F.concat(fixed(ms / 1000.0, 1), F.lit("s"))).otherwise(F.format_string("%dm%ds", minutes, seconds))


def human_size(n: Column) -> Column:
    return F.when(n >= 1_048_576, F.concat(fixed(n / 1_048_576.0, 1), F.lit("M"))).when(n >= 1024, F.concat(fixed(n / 1024.0, 1), F.lit("K"))).otherwise(F.format_string("%dB", n))


def format_cpt(x: Column) -> Column:
    """Dollars per million tokens from dollars per token; zero where there is no positive number."""
    return F.when(F.isnan(x) | x.isNull() | (x <= 0) | (x == float("inf")), "$0.00/MTok").otherwise(F.concat(F.lit("$"), fixed(x * 1_000_000.0, 2), F.lit("/MTok")))
