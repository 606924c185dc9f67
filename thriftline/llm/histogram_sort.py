"""Sharding by histogram sort.

Rows get a uniform key from their text. Splitters between shards are found by
counting, in one aggregation per round, the exact bytes below candidate key
boundaries over all partitions, and refining the candidates around each target
until every splitter meets the tolerance. Then rows are exchanged once.

Equal texts share a key and so a shard. A group of copies that is large beside
the tolerance would stand in the way of a splitter, and one of many rows (if
only of empty texts) would be ranked by one task; such groups (at most twice
n_shards / group_share of them) are placed whole, largest first, and splitters
share out what is left. Rows of such a group have keys of their own within the
shard. Only a group whose bytes fit no shard is spread over several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm.common import KEY_BITS, gapless_rank, n_rank_buckets, stash, unit_key

CELLS = 256


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group, row): size in bytes plus 1, a null text has none and a null crc; row numbers the rows."""
    raw = F.encode("text", "utf-8")
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("group"), F.monotonically_increasing_id().alias("row"))


def place_groups(rows: DataFrame, n_rows: int, n_shards: int, ideal: float, group_share: float) -> tuple[dict[int, int], list[int]]:
    """Shards of the large groups, and the groups to spread."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    is_large = (F.col("size") > F.lit(group_share * ideal)) | (F.col("n") > F.lit(group_share * n_rows / n_shards))
    large = groups.filter(is_large).collect()  # at most 2 * n_shards / group_share rows
    load, placed, spread = [0.0] * n_shards, {}, []
    for r in sorted(large, key=lambda r: (-r["size"], r["group"])):
        s = min(range(n_shards), key=lambda i: (load[i], i))
        if load[s] + r["size"] > ideal:
            spread.append(r["group"])
        else:
            load[s] += r["size"]
            placed[r["group"]] = s
    return placed, spread


def find_splitters(rows: DataFrame, targets: list[float], slack: float) -> list[int]:
    """Keys k such that the bytes of rows (key, size) with key < k are within slack of each target."""
    top = 1 << KEY_BITS
    found: dict[int, int] = {}
    brackets = {i: (0, top, 0) for i in range(len(targets))}  # low, high, bytes below low
    while brackets:
        ranges = sorted({(lo, hi, below) for lo, hi, below in brackets.values()})
        cell: Column = F.lit(None).cast("struct<r:int,c:int>")
        for n, (lo, hi, _) in enumerate(ranges):
            width = max(1, -(-(hi - lo) // CELLS))
            inside = (F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi))
            cell = F.when(inside, F.struct(F.lit(n).alias("r"), F.expr(f"cast((key - {lo}L) div {width}L as int)").alias("c"))).otherwise(cell)
        counted = rows.select(cell.alias("cell"), "size").filter("cell is not null").groupBy("cell.r", "cell.c").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        at: dict[int, list] = {n: [] for n in range(len(ranges))}
        for r in counted:
            at[r["r"]].append((r["c"], r["size"], r["n"]))
        for i, (lo, hi, below) in list(brackets.items()):
            width, sum_below, last = max(1, -(-(hi - lo) // CELLS)), below, None
            for c, size, n in sorted(at[ranges.index((lo, hi, below))]):
                if sum_below + size >= targets[i]:
                    last = (lo + c * width, min(hi, lo + (c + 1) * width), sum_below, sum_below + size, n)
                    break
                sum_below += size
            if last is None:
                found[i] = hi
            else:
                left, right, under, over, n = last
                nearer = left if targets[i] - under <= over - targets[i] else right
                if min(targets[i] - under, over - targets[i]) <= slack or n == 1 or right - left <= 1:
                    found[i] = nearer
                else:
                    brackets[i] = (left, right, under)
                    continue
            del brackets[i]
    return [found[i] for i in range(len(targets))]


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, group_share: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row of docs in one of n_shards shards of near equal bytes.

    slot is gapless from 0 within a shard, by key and doc_id. Splitters are
    within tolerance of an even share, as far as single rows allow. Null and
    empty texts have size 1 and are groups of their own; a null doc_id takes
    part like any other; repeated rows share a shard and take slots each. The
    rows of a large group are spread over its shard's slots by a number that
    they get when they are first read, so no task ranks a whole group. An
    empty table gives no rows. Other columns are not read.
    """
    rows = stash(sized(docs), "sized")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ideal = max(1.0, total / n_shards)
    placed, spread = place_groups(rows, n_rows, n_shards, ideal, group_share)
    shard_of = F.lit(None).cast("int")
    if placed:
        shard_of = F.element_at(F.create_map(*[F.lit(x) for kv in placed.items() for x in kv]), F.col("group"))
    loose = F.col("group").isin(spread) if spread else F.lit(False)
    if placed:
        loose = loose | F.col("group").isin(list(placed))
    rows = rows.withColumn("key", F.when(loose, unit_key(F.lit(1), "group", "row")).otherwise(unit_key(F.lit(0), "group"))).withColumn("pinned", shard_of)
    free = [ideal] * n_shards
    if placed:
        for r in rows.filter("pinned is not null").groupBy("pinned").agg(F.sum("size").alias("size")).collect():
            free[r["pinned"]] -= r["size"]
    targets = [sum(free[: i + 1]) for i in range(n_shards - 1)]
    splitters = find_splitters(rows.filter("pinned is null"), targets, tolerance * ideal)
    above = sum((F.col("key") >= F.lit(s)).cast("int") for s in splitters) if splitters else F.lit(0)
    rows = rows.withColumn("shard", F.coalesce("pinned", above).cast("int"))
    ranked = gapless_rank(rows, ["shard"], "key", ["doc_id"], "slot", n_rank_buckets(n_rows // n_shards + 1))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
