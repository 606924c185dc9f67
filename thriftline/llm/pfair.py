"""Mixing sources to target weights by Pfair scheduling.

A source with share w of the mix gets the k-th of its blocks (from 0) released
at slot floor(k / w), with deadline ceil((k + 1) / w). Filling each slot with
the released block of the earliest deadline keeps every source, after any
number of slots, within less than one block of its share. With integer weights
the schedule repeats after as many slots as the weights sum to, so one period
is computed, by a fold over its slots, and every block finds its slot from the
period by arithmetic: no step looks at the blocks one after another.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.llm.common import gapless_rank, n_rank_buckets, shielded

BLOCK_ROWS = 64
REST = "*"
#: Weights of the sources of the query: 8, 4, 2, 1 in turn. Sources not named share the weight of REST.
WEIGHTS = {**{f"src{i}": (8, 4, 2, 1)[i % 4] for i in range(20)}, REST: 1}


def pool_of(weights: Mapping[str, int]) -> Column:
    """The source whose weight a row counts under."""
    return F.when(F.col("source").isin([w for w in weights if w != REST]), F.col("source")).otherwise(REST)


def period(pools: DataFrame) -> DataFrame:
    """One period of the schedule for pools (pool, weight, n): (pool, weight, turn, place, length).

    turn counts a pool's blocks within the period, place is the slot of that
    block, length the number of slots. pools has a row per weight at most.
    """
    one = pools.agg(F.sort_array(F.collect_list(F.struct("pool", "weight"))).alias("pools"), F.sum("weight").cast("long").alias("length"))

    def fill(acc: Column, slot: Column) -> Column:
        def due(p: Column, i: Column) -> Column:
            k, w = F.get(acc["done"], i), p["weight"]
            release = F.floor(k * F.col("length") / w)
            return F.when(release <= slot, F.struct(F.ceil((k + 1) * F.col("length") / w).alias("deadline"), i.alias("i")))

        earliest = F.array_min(F.filter(F.transform("pools", due), lambda x: x.isNotNull()))

        def give(x: Column) -> Column:
            return F.struct(
                F.transform(acc["done"], lambda k, i: k + F.when(i == x["i"], 1).otherwise(0).cast("long")).alias("done"),
                F.concat(acc["slots"], F.array(F.struct(x["i"].alias("i"), F.get(acc["done"], x["i"]).alias("turn")))).alias("slots"),
            )

        return F.get(F.transform(F.array(earliest), give), 0)

    start = F.struct(F.transform("pools", lambda p: F.lit(0).cast("long")).alias("done"), F.expr("cast(array() as array<struct<i:int,turn:bigint>>)").alias("slots"))
    one = one.filter("length is not null").withColumn("slots", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), start, fill)["slots"])
    rows = one.select("pools", "length", F.posexplode("slots").alias("place", "s"))
    pool = F.get("pools", F.col("s.i"))
    return rows.select(pool["pool"].alias("pool"), pool["weight"].cast("long").alias("weight"), F.col("s.turn").alias("turn"), F.col("place").cast("long").alias("place"), "length")


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with mix_pool, mix_block, mix_slot, mix_offset, mix_on_target.

    Reading rows by (mix_slot, mix_offset) gives the mix; blocks have
    block_rows rows but for a pool's last. Within a pool rows go by a hash of
    doc_id, then doc_id. Slots before the first that its pool can no longer
    fill are mix_on_target: there the deviation is under one block. After it,
    the slots of exhausted pools stay empty and the others go on in their
    proportions; no row is dropped. weights are positive integers, at least
    one of them for REST: sources not named, and null, share it. Repeated rows
    are placed each; extra columns pass through, those of the same names as the
    new ones are replaced; an empty table gives no rows.
    """
    docs = docs.drop("mix_pool", "mix_block", "mix_slot", "mix_offset", "mix_on_target")
    return shielded(docs, ["doc_id", "source"], lambda d: _mix(d, weights, block_rows))


def _mix(docs: DataFrame, weights: Mapping[str, int], block_rows: int) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    docs = docs.withColumn("mix_pool", pool_of(weights)).withColumn("_key", F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long") * 4, F.lit(0)))
    slim = docs.groupBy("mix_pool").agg(F.count("*").alias("n"))
    pools = slim.select(F.col("mix_pool").alias("pool"), F.element_at(table, F.col("mix_pool")).alias("weight"), "n")
    blocks = F.ceil(F.col("n") / block_rows)
    plan = period(pools).join(F.broadcast(pools.select("pool", "n")), "pool")
    # the first slot that a pool can't fill is that of the block after its last
    next_slot = F.when(F.col("turn") == blocks % F.col("weight"), F.floor(blocks / F.col("weight")) * F.col("length") + F.col("place"))
    plan = plan.withColumn("horizon", F.min(next_slot).over(Window.partitionBy("length")))
    n_rows = docs.count()
    ranked = gapless_rank(docs, ["mix_pool"], "_key", ["doc_id"], "_rank", n_rank_buckets(n_rows))
    ranked = ranked.withColumn("mix_block", F.floor(F.col("_rank") / block_rows))
    ranked = ranked.join(F.broadcast(pools.select(F.col("pool").alias("_pool"), F.col("weight").cast("long").alias("_weight"))), F.col("mix_pool") == F.col("_pool"))
    placed = ranked.join(F.broadcast(plan), (F.col("mix_pool") == F.col("pool")) & (F.col("mix_block") % F.col("_weight") == F.col("turn")))
    slot = F.floor(F.col("mix_block") / F.col("weight")) * F.col("length") + F.col("place")
    return placed.select(*docs.drop("_key").columns, "mix_block", slot.alias("mix_slot"), (F.col("_rank") % block_rows).cast("int").alias("mix_offset"), (slot < F.col("horizon")).alias("mix_on_target"))


def in_mix_order(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, slots: bool = False) -> DataFrame:
    """The rows of docs laid out in the order of the mix, with the columns of docs; with slots, mix_slot and mix_offset too.

    The layout does not outlast a reader that packs files by size; the columns do.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["mix_slot", "mix_offset"]
    docs = docs.drop(*order) if slots else docs

    def laid_out(d: DataFrame) -> DataFrame:
        return _mix(d, weights, block_rows).repartitionByRange(n, *order).sortWithinPartitions(*order).select(*d.columns, *(order if slots else []))

    return shielded(docs, ["doc_id", "source"], laid_out)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source")).withColumnRenamed("mix_pool", "pool")


#: op5 for DuckDB: the same schedule, slot by slot in a recursive query.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN regexp_matches(source, '^src(1?[0-9])$') THEN source ELSE '*' END AS pool FROM documents
), p AS (
  SELECT pool, count(*) AS n, CASE WHEN pool = '*' THEN 1 ELSE [8, 4, 2, 1][(substr(pool, 4)::INT % 4) + 1] END AS w FROM d GROUP BY pool
), q AS (SELECT list(pool ORDER BY pool) AS ps, list(w ORDER BY pool) AS ws, sum(w)::BIGINT AS len FROM p
), s AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS pick, 0::BIGINT AS turn, list_transform(ws, lambda x: 0::BIGINT) AS done FROM q
  UNION ALL
  SELECT slot, pick, done[pick], list_transform(done, lambda k, i: CASE WHEN i = pick THEN k + 1 ELSE k END) FROM (
    SELECT s.slot + 1 AS slot, s.done, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: (s.done[i] * len) // ws[i] <= s.slot + 1),
      lambda i: {'deadline': ((s.done[i] + 1) * len + ws[i] - 1) // ws[i], 'i': i})).i AS pick
    FROM s, q WHERE s.slot + 1 < len)
), plan AS (SELECT ps[pick] AS pool, ws[pick] AS w, turn, slot AS place, len FROM s, q WHERE slot >= 0
), h AS (SELECT min(((n + 63) // 64) // plan.w * len + place) AS horizon FROM plan JOIN p USING (pool) WHERE turn = ((n + 63) // 64) % plan.w
), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY substr(md5(doc_id::VARCHAR), 1, 15), doc_id) - 1 AS rnk FROM d)
SELECT doc_id, source, r.pool, (rnk // 64)::BIGINT AS mix_block, ((rnk // 64) // plan.w * len + place)::BIGINT AS mix_slot,
  (rnk % 64)::INT AS mix_offset, (rnk // 64) // plan.w * len + place < horizon AS mix_on_target
FROM r JOIN p USING (pool) JOIN plan ON plan.pool = r.pool AND plan.turn = (rnk // 64) % p.w, h
"""
