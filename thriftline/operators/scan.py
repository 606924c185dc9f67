"""Values that run along the lines of an output, in two levels.

An output may hold any share of all lines, so no window spans one. Its lines
are cut into chunks of CHUNK_LINES; values run inside a chunk, the last value
of each chunk is its summary, summaries are composed along the output, and
what comes out before a chunk enters the values of its lines. Only summaries,
one row a chunk, are sorted by output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_LINES = 65_536
#: The chunk of a line: its output (or another group) and the chunk's number there. Null groups are equal in a struct.
AT = "_at"


def chunked(rows: DataFrame, group: str = "output_id", order: str = "line_no") -> DataFrame:
    """rows with their chunk, dealt by it."""
    return rows.withColumn(AT, F.struct(F.col(group).alias("g"), F.floor(F.col(order) / CHUNK_LINES).cast("long").alias("c"))).repartition(AT)


def total(e: Column) -> tuple:
    """The sum of e from an output's first line to this one; nulls count as 0."""
    return ("total", F.coalesce(e.cast("long"), F.lit(0).cast("long")), None)


def count(flag: Column) -> tuple:
    """How many lines to this one have flag."""
    return total(flag.cast("int"))


def largest(e: Column) -> tuple:
    """The largest value of e to this line."""
    return ("largest", e, None)


def latest(e: Column) -> tuple:
    """The last value of e that is not null, to this line."""
    return ("latest", e, None)


def earlier(e: Column) -> tuple:
    """The last value of e that is not null, before this line."""
    return ("earlier", e, None)


def since(e: Column, reset: Column) -> tuple:
    """The sum of e from the last line with reset, it included, to this one; from the first line where there is none."""
    return ("since", F.coalesce(e.cast("long"), F.lit(0).cast("long")), F.coalesce(reset, F.lit(False)))


def running(rows: DataFrame, order: str = "line_no", **values: tuple) -> DataFrame:
    """Chunked rows with values (name=total(...), latest(...) and so on) that run along each output in the order of `order`."""
    to_here = Window.partitionBy(AT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    to_last = Window.partitionBy(AT).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner, ends = rows, {}
    for name, (kind, e, reset) in values.items():
        inside = f"_in_{name}"
        if kind == "total":
            inner = inner.withColumn(inside, F.sum(e).over(to_here))
        elif kind == "largest":
            inner = inner.withColumn(inside, F.max(e).over(to_here))
        elif kind in ("latest", "earlier"):
            inner = inner.withColumn(inside, F.last(e, ignorenulls=True).over(to_here if kind == "latest" else to_last))
        else:
            inner = inner.withColumn(f"_e_{name}", e).withColumn(f"_sum_{name}", F.sum(e).over(to_here)).withColumn(f"_reset_{name}", reset)
            base = F.last(F.when(F.col(f"_reset_{name}"), F.col(f"_sum_{name}") - F.col(f"_e_{name}")), ignorenulls=True).over(to_here)
            inner = inner.withColumn(f"_base_{name}", base).withColumn(inside, F.col(f"_sum_{name}") - F.coalesce(f"_base_{name}", F.lit(0)))
        # an earlier value of the next chunk's first line is the latest one of this chunk
        ends[name] = F.coalesce(e, F.col(inside)) if kind == "earlier" else F.col(inside)
    fields = [e.alias(n) for n, e in ends.items()] + [F.col(f"_base_{n}").isNotNull().alias(f"_new_{n}") for n, v in values.items() if v[0] == "since"]
    chunks = inner.groupBy(AT).agg(F.max_by(F.struct(*fields), order).alias("s")).select(AT, "s.*")
    carry = chunks
    before = Window.partitionBy(f"{AT}.g").orderBy(f"{AT}.c").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _, _) in values.items():
        if kind == "total":
            carry = carry.withColumn(f"_to_{name}", F.sum(name).over(before))
        elif kind == "largest":
            carry = carry.withColumn(f"_to_{name}", F.max(name).over(before))
        elif kind in ("latest", "earlier"):
            carry = carry.withColumn(f"_to_{name}", F.last(name, ignorenulls=True).over(before))
        else:
            # chunks since the last one with a reset, that one included
            carry = carry.withColumn(f"_at_{name}", F.sum(F.col(f"_new_{name}").cast("int")).over(Window.partitionBy(f"{AT}.g").orderBy(f"{AT}.c").rowsBetween(Window.unboundedPreceding, 0)))
            in_reach = Window.partitionBy(f"{AT}.g", f"_at_{name}").orderBy(f"{AT}.c").rowsBetween(Window.unboundedPreceding, 0)
            carry = carry.withColumn(f"_reach_{name}", F.sum(name).over(in_reach))
            carry = carry.withColumn(f"_to_{name}", F.lag(f"_reach_{name}").over(Window.partitionBy(f"{AT}.g").orderBy(f"{AT}.c")))
    joined = inner.join(carry.select(AT, *[f"_to_{n}" for n in values]), AT)
    out = {}
    for name, (kind, _, _) in values.items():
        inside, to = F.col(f"_in_{name}"), F.col(f"_to_{name}")
        if kind == "total":
            out[name] = inside + F.coalesce(to, F.lit(0))
        elif kind == "largest":
            out[name] = F.greatest(inside, to)
        elif kind in ("latest", "earlier"):
            out[name] = F.coalesce(inside, to)
        else:
            out[name] = inside + F.when(F.col(f"_base_{name}").isNull(), F.coalesce(to, F.lit(0))).otherwise(0)
    return joined.select(*rows.columns, *[c.alias(n) for n, c in out.items()])
