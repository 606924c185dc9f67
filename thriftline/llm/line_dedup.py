"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The state is a table of references (which document holds which line, how
often), a table of the repeated lines with their exact counts, and per shard of
the key space a cuckoo filter of the repeated lines. Inserting or deleting
documents changes the references, recounts the lines they touch, and inserts
or deletes in the filters what became, or is no longer, repeated. Lines of a
document meet their shard's filter first; only what it lets through is looked
up in the exact table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm.common import ascii_lower, join_heavy, shielded, stash
from thriftline.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
#: Repeated lines to a shard, rows to a probing group, and the share of its cells from which on a filter is built anew.
SHARD_KEYS, GROUP_ROWS, MOST_LOAD = 200_000, 500_000, 0.8
FILTER = "shard int, cells binary, spare array<bigint>"
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class State:
    refs: DataFrame  # h1, h2, doc_id, n: lines of the document
    repeated: DataFrame  # h1, h2, n_docs, last_doc
    filters: DataFrame  # FILTER
    n_shards: int
    min_docs: int


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): the lines whose key has at least min_chars characters, by the key's 128-bit hash.

    doc_id and text_hash tell texts apart where rows with one doc_id differ.
    """
    keyed = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return keyed.filter(F.length("key") >= min_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def references(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"))


def count_repeated(refs: DataFrame, min_docs: int) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= min_docs)


def shard_of(n_shards: int) -> Column:
    return F.pmod("h2", F.lit(n_shards)).cast("int")


def build_filters(repeated: DataFrame, n_shards: int) -> DataFrame:
    def build(keys: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.sized(2 * len(keys))  # room to grow
        made.insert(keys.h1.to_numpy(), keys.h2.to_numpy())
        return pd.DataFrame({"shard": [int(keys.shard.iloc[0])], "cells": [made.cells.tobytes()], "spare": [made.spare]})

    return repeated.select(*KEY, shard_of(n_shards).alias("shard")).groupBy("shard").applyInPandas(build, FILTER)


def shards_for(repeated: DataFrame) -> int:
    return max(1, -(-repeated.count() // SHARD_KEYS))


def build(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, long: DataFrame | None = None) -> State:
    """The state that holds docs. Rows with the same doc_id are one document, which holds the lines of all of them; a null doc_id takes no part."""
    refs = stash(references(long_lines(docs, min_chars) if long is None else long), "line-refs")
    repeated = stash(count_repeated(refs, min_docs), "repeated-lines")
    n_shards = shards_for(repeated)
    return State(refs, repeated, stash(build_filters(repeated, n_shards), "line-filters"), n_shards, min_docs)


def _changed(state: State, refs: DataFrame, touched: DataFrame) -> State:
    """The state with refs, in which only the lines of touched (h1, h2) may have other counts."""
    touched = stash(touched.select(*KEY).distinct(), "touched-lines")
    now = stash(count_repeated(refs.join(touched, KEY, "left_semi"), state.min_docs), "recounted-lines")
    was = state.repeated.join(touched, KEY, "left_semi")
    delta = now.select(*KEY, F.lit(True).alias("add")).join(was.select(*KEY), KEY, "left_anti").unionByName(was.select(*KEY, F.lit(False).alias("add")).join(now.select(*KEY), KEY, "left_anti"))
    delta = delta.withColumn("shard", shard_of(state.n_shards))

    def update(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.read(old.cells.iloc[0], old.spare.iloc[0]) if len(old) else CuckooFilter.sized(2 * len(change))
        out, add = change[~change["add"].astype(bool)], change[change["add"].astype(bool)]
        made.delete(out.h1.to_numpy(), out.h2.to_numpy())
        if made.load(len(add)) <= MOST_LOAD:
            made.insert(add.h1.to_numpy(), add.h2.to_numpy())
        else:
            made = None  # too full to grow; built anew below
        shard = (old if len(old) else change).shard.iloc[0]
        return pd.DataFrame({"shard": [int(shard)], "cells": [made and made.cells.tobytes()], "spare": [made and made.spare]})

    filters = stash(state.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(update, FILTER), "line-filters")
    repeated = stash(state.repeated.join(touched, KEY, "left_anti").unionByName(now), "repeated-lines")
    if (n_shards := shards_for(repeated)) > 2 * state.n_shards:  # shards have outgrown their size
        return replace(state, refs=refs, repeated=repeated, n_shards=n_shards, filters=stash(build_filters(repeated, n_shards), "line-filters"))
    full = filters.filter("cells is null").select("shard")
    if not full.isEmpty():
        anew = repeated.withColumn("shard", shard_of(state.n_shards)).join(full, "shard", "left_semi")
        filters = stash(filters.filter("cells is not null").unionByName(build_filters(anew, state.n_shards)), "line-filters")
    return replace(state, refs=refs, repeated=repeated, filters=filters)


def delete(state: State, doc_ids: DataFrame) -> State:
    """The state without the documents of doc_ids (doc_id)."""
    gone = state.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    refs = stash(state.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*KEY, "doc_id", "n"), "line-refs")
    return _changed(state, refs, gone)


def insert(state: State, docs: DataFrame, min_chars: int = MIN_CHARS) -> State:
    """The state with docs too. Documents that it holds already are replaced."""
    ids = docs.select("doc_id").distinct()
    new = stash(references(long_lines(docs, min_chars)), "new-line-refs")
    old = state.refs.join(ids, "doc_id", "left_semi")
    refs = stash(state.refs.join(ids, "doc_id", "left_anti").unionByName(new).select(*KEY, "doc_id", "n"), "line-refs")
    return _changed(state, refs, old.select(*KEY).unionByName(new.select(*KEY)))


def probe(long: DataFrame, state: State) -> DataFrame:
    """The lines that their shard's filter lets through. A shard's lines are dealt to as many groups as they ask for, each with a copy of its filter."""
    shards = long.groupBy(shard_of(state.n_shards).alias("shard")).agg(F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.lit(-(-256 // state.n_shards))).cast("int").alias("salts"))
    shards = F.broadcast(stash(shards, "line-shards"))  # a row per shard: one for SHARD_KEYS repeated lines
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.col("salts")).cast("int")
    dealt = long.withColumn("shard", shard_of(state.n_shards)).join(shards, "shard").withColumn("salt", salt).drop("salts")
    copies = state.filters.join(shards, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    names = ["doc_id", "text_hash", "pos", *KEY]

    def look_up(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filters.empty:
            return rows.iloc[:0][names]
        held = CuckooFilter.read(filters.cells.iloc[0], filters.spare.iloc[0])
        return rows.loc[held.contains(rows.h1.to_numpy(), rows.h2.to_numpy()), names]

    return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(look_up, long.select(*names).schema)


def dropped_lines(long: DataFrame, state: State) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines to drop: repeated, and the document is not the last that holds them."""
    maybe = stash(probe(long, state), "filtered-lines")
    found = join_heavy(maybe, state.repeated.select(*KEY, "n_docs", "last_doc"), KEY, "n_docs", state.refs.count())
    return found.filter("doc_id <> last_doc").select("doc_id", "text_hash", "pos")


def apply(docs: DataFrame, state: State, long: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept: the text without the lines to drop. long: long_lines(docs)."""
    drops = dropped_lines(long, state).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("pos").alias("_drop"))
    joined = docs.join(drops.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    split = lines(F.col("text"))
    n_lines = F.size(split)
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    return joined.select(*[docs[c] for c in docs.columns], n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and kept, its text without repeated lines.

    A line's key is the line without blanks (space, tab to carriage return) at
    both ends, A-Z lower-cased. Keys of at least min_chars code points that at
    least min_docs documents hold lose all their lines except in the largest
    doc_id. A null or empty text is one empty line and is kept as empty. Rows
    with the same doc_id count as one document, which holds the lines of all
    of them; each loses lines of its own text only, copies of a row the same
    ones. A null doc_id neither counts nor loses lines. Extra
    columns pass through, those of the same names as the new ones are replaced.
    An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    long = stash(long_lines(docs, min_chars), "long-lines")
    return apply(docs, build(docs, min_docs, min_chars, long), long)


def deduped(docs: DataFrame, **how) -> DataFrame:
    """docs with its lines deduplicated, and the columns of docs."""
    made = shielded(docs, ["doc_id", "text"], lambda d: dedup_lines(d, **how).withColumn("text", F.col("kept")).drop("n_lines", "n_dropped", "kept"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: op6 for DuckDB, with a join of all lines on their key.
SQL = r"""
WITH k AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), h AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> last_doc AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
