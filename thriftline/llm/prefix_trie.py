"""Conversation prefix trie by a splitter skeleton.

A conversation's path is the sequence of its turns' digests. Paths are dealt
to shards by range: splitters are paths too, and the members of a node lie
side by side in the order of paths. A node that spans two shards is therefore
a prefix of the splitter between them. The trie of all splitter paths, the
skeleton, is broadcast; each shard walks its sorted paths once, with a stack
as deep as a path, finishes every node that isn't in the skeleton, and gives
partial aggregates of skeleton nodes, which are reduced and then rolled up
along the skeleton.

Long conversations are cut into chunks of CHUNK_TURNS turns. Chunks of one
level form tries of their own, one below each node at which a chunk before it
ended. Levels are worked off from the last one; what lies below such a node is
carried to the level above it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.llm.common import stash

UNIT = 16  # bytes of a digest
#: Turns to a chunk, conversations to a shard while there are fewer than MAX_SHARDS, sampled paths to a splitter, turns that a rank's bucket spans, ids to a block.
CHUNK_TURNS, SHARD_ROWS, MAX_SHARDS, SAMPLED, TURN_SPAN, BLOCK_IDS = 256, 2_000, 2_048, 8, 4_096, 4_096
BASE_STEP, BASE_TURNS = 100, 5
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
WALKED = f"kind string, skel int, shard int, block int, ids string, chars bigint, at binary, parent_at binary, below_children bigint, below_leaves bigint, below_saved bigint, {NODE}"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): turns by place from 1, ordered by turn (null first), ties by digest.

    No task sees a whole conversation: places count inside a span of turns and
    start after the turns of all spans before it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.md5(F.encode(F.concat(F.length(role), F.lit(":"), role, text), "utf-8")).alias("digest"), F.length(text).cast("long").alias("chars"),
        F.coalesce(F.floor(F.col("turn") / TURN_SPAN).cast("long"), F.lit(-(1 << 62))).alias("span"),
    )
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select("conv_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.join(starts, ["conv_id", "span"]).select("conv_id", (F.col("start") + F.row_number().over(inside)).cast("long").alias("place"), "digest", "chars")


def head_turns() -> Column:
    return (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % (BASE_TURNS + 1)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns of the rebuilt conversations, and (conv_id) of those that have none.

    Conversation c starts with the first h turns of conversation c - c % 100
    (all if it has fewer, none if there is no such one) and goes on with its
    own turns after its first h; h = crc32(c) % 6. % has the sign of c.
    """
    base = F.col("conv_id") - F.col("conv_id") % BASE_STEP
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    bases = sizes.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.least("n_own", F.lit(BASE_TURNS)).alias("n_base"))
    with_base = lambda df: df.withColumn("base", base).withColumn("h", head_turns()).join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = with_base(turns).filter("place > h").select("conv_id", (F.col("given") + F.col("place") - F.col("h")).alias("place"), "digest", "chars")
    firsts = turns.filter(F.col("conv_id") == base).filter(F.col("place") <= BASE_TURNS).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    heads = sizes.withColumn("base", base).withColumn("h", head_turns()).join(firsts, "base").filter("place <= h").select("conv_id", "place", "digest", "chars")
    bare = with_base(sizes).filter("n_own <= h and given = 0").select("conv_id")
    return own.unionByName(heads), bare


def chunks_of(turns: DataFrame, bare: DataFrame, chunk_turns: int) -> DataFrame:
    """(conv_id, level, path, chars, at, next): pieces of at most chunk_turns turns; at and next name the nodes before and after a piece, null at either end."""
    turns = turns.withColumn("level", F.floor((F.col("place") - 1) / chunk_turns).cast("int"))
    mixed = [F.bit_xor(F.xxhash64("place", "digest", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    cut = turns.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("t"), *mixed)
    along = Window.partitionBy("conv_id").orderBy("level")
    name = F.unhex(F.concat(*[F.lpad(F.hex(F.bit_xor(f"x{i}").over(along.rowsBetween(Window.unboundedPreceding, 0))), 16, "0") for i in (0, 1)]))
    cut = cut.withColumn("name", name)
    cut = cut.select(
        "conv_id", "level", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("path"), F.transform("t", lambda t: t["chars"]).alias("chars"),
        F.lag("name").over(along).alias("at"), F.when(F.lead("level").over(along).isNotNull(), F.col("name")).alias("next"),
    )
    none = bare.select("conv_id", F.lit(0).alias("level"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("chars"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("next"))
    return cut.unionByName(none)


def splitters_of(rows: DataFrame) -> list[tuple[bytes, int]]:
    """Keys (key, conv_id) that part rows into shards of about the same size, from a sample of SAMPLED rows a shard at most MAX_SHARDS times.

    They steer how even shards are, and nothing else.
    """
    n = rows.count()
    shards = min(MAX_SHARDS, -(-n // SHARD_ROWS))
    if shards <= 1:
        return []
    every = max(1, n // (shards * SAMPLED))
    sample = rows.filter(F.pmod(F.xxhash64("conv_id", F.lit("splitters")), F.lit(every)) == 0).select("key", "conv_id").toArrow()
    keys = sorted(set(zip((bytes(k) for k in sample["key"].to_pylist()), sample["conv_id"].to_pylist())))
    return [keys[i * len(keys) // shards] for i in range(1, shards)] if len(keys) >= shards else keys


class Skeleton:
    """The trie of splitter paths. Node 0 is the empty path; places of nodes follow their parents'."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.units = [-1], [0]
        for key, _ in splitters:
            at = 0
            for u in range(0, len(key), UNIT):
                step = (at, key[u : u + UNIT])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.units.append(self.units[at] + 1)
                at = self.child[step]


class _Node:
    __slots__ = ("skel", "chars", "low", "n", "children", "leaves", "saved", "sha", "ids", "blocks", "waiting", "below", "at")

    def __init__(self, skel: int, chars: int):
        self.skel, self.chars, self.low, self.n, self.children, self.leaves, self.saved = skel, chars, None, 0, 0, 0, 0
        self.sha = self.below = self.at = None
        self.ids, self.blocks, self.waiting = [], 0, []


class _Walk:
    """One pass over the sorted rows of a shard."""

    def __init__(self, skeleton: Skeleton, level: int, first_depth: int):
        self.skeleton, self.first_depth, self.inner = skeleton, first_depth, level > 0
        self.out: dict[str, list] = {f.split()[0]: [] for f in WALKED.split(", ")}
        self.start(None)

    def start(self, shard: int | None) -> None:
        self.shard, self.key, self.stack = shard, b"", [_Node(0, 0)]

    def emit(self, **values) -> None:
        for name, column in self.out.items():
            column.append(values.get(name))

    def add(self, key: bytes, conv_id: int, chars: list[int], after: bytes | None, below: tuple | None) -> None:
        same, most = 0, min(len(key), len(self.key))
        if key == self.key:
            same = len(key)
        else:
            while same < most and key[same : same + UNIT] == self.key[same : same + UNIT]:
                same += UNIT
        self.close(same // UNIT + 1)
        extra = len(key) // UNIT - len(chars)  # the node's name that chunks of inner levels begin with
        for u in range(same, len(key), UNIT):
            top = self.stack[-1]
            skel = self.skeleton.child.get((top.skel, key[u : u + UNIT]), -1) if top.skel >= 0 else -1
            self.stack.append(_Node(skel, chars[u // UNIT - extra] if u // UNIT >= extra else 0))
            if self.inner and u == 0:
                self.stack[-1].at = key[:UNIT]
        self.key, top = key, self.stack[-1]
        top.n += 1
        top.low = conv_id if top.low is None else min(top.low, conv_id)
        if after is None:
            top.ids.append(conv_id)
            if len(top.ids) == BLOCK_IDS:
                self.flush_ids(top)
        else:
            top.at, top.below = after, below

    def flush_ids(self, node: _Node) -> None:
        if not node.ids:
            return
        told = ",".join(map(str, node.ids))
        if node.skel >= 0:
            self.emit(kind="ends", skel=node.skel, shard=self.shard, block=node.blocks, ids=told)
        else:
            node.sha = node.sha or hashlib.sha256()
            node.sha.update(("," + told if node.blocks else told).encode())
        node.ids, node.blocks = [], node.blocks + 1

    def close(self, least: int) -> None:
        """Finish the nodes on the stack from place least on."""
        while len(self.stack) > least:
            node = self.stack.pop()
            self.flush_ids(node)
            parent = self.stack[-1] if self.stack else None
            if node.skel >= 0:
                # partial: without what skeleton nodes themselves add
                children, leaves, saved = node.below or (0, 0, 0)
                self.emit(kind="part", skel=node.skel, chars=node.chars, at=node.at, conv_id=node.low, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, below_children=children, below_leaves=leaves, below_saved=saved)
                if parent:
                    parent.n, parent.low = parent.n + node.n, node.low if parent.low is None else min(parent.low, node.low)
                    parent.leaves, parent.saved = parent.leaves + node.leaves, parent.saved + node.saved
                continue
            for child in node.waiting:
                self.emit(kind="node", **child, parent_conv_id=node.low)
            if node.below:
                node.children, node.leaves, node.saved = node.below
            leaves, place = node.leaves if node.children else 1, len(self.stack)
            parent.n, parent.low = parent.n + node.n, node.low if parent.low is None else min(parent.low, node.low)
            if self.inner and place == 1:
                self.emit(kind="root", at=node.at, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved)
                parent.leaves, parent.saved = parent.leaves + leaves, parent.saved + node.saved
                continue
            saved = node.saved + (node.n - 1) * node.chars
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
            made = dict(at=node.at, conv_id=node.low, depth=self.first_depth + place, n_convs=node.n, n_children=node.children, n_leaves=leaves, saved_tokens=saved, ends_sha256=node.sha.hexdigest() if node.sha else EMPTY_SHA)
            if self.inner and place == 2:
                self.emit(kind="node", parent_at=parent.at, **made)
            elif parent.skel >= 0:
                self.emit(kind="node", skel=parent.skel, **made)
            else:
                parent.waiting.append(made)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict(self.out, schema)
        self.out = {name: [] for name in self.out}
        return made


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ddl.split(", ")])


def walk_shards(rows: DataFrame, splitters: list[tuple[bytes, int]], level: int, first_depth: int) -> DataFrame:
    """WALKED rows of all shards: finished nodes, partial aggregates and ends of skeleton nodes, and what lies below the roots of an inner level."""
    shared = rows.sparkSession.sparkContext.broadcast((splitters, Skeleton(splitters)))
    names = ["shard", "key", "conv_id", "chars", "next", "below_children", "below_leaves", "below_saved"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value[0]
        for b in batches:
            shards = [bisect_right(bounds, at) for at in zip(b["key"].to_pylist(), b["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *b.columns], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, schema = _Walk(shared.value[1], level, first_depth), arrow_schema(WALKED)
        for b in batches:
            for shard, key, conv_id, chars, after, *below in zip(*(c.to_pylist() for c in b.columns)):
                if shard != made.shard:
                    if made.shard is not None:
                        made.close(0)
                    made.start(shard)
                made.add(key, conv_id, chars, after, tuple(below) if below[0] is not None else None)
            yield made.batch(schema)
        if made.shard is not None:
            made.close(0)
        yield made.batch(schema)

    dealt = rows.select(*names[1:]).mapInArrow(deal, "shard int, key binary, conv_id bigint, chars array<bigint>, next binary, below_children bigint, below_leaves bigint, below_saved bigint")
    return dealt.repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "key", "conv_id").mapInArrow(walk, WALKED)


def hashed_ends(walked: DataFrame) -> DataFrame:
    """(skel, ends_sha256) of skeleton nodes: the blocks of their ids, in order, streamed through one hash each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, ([], [])
        for b in batches:
            for skel, ids in zip(b["skel"].to_pylist(), b["ids"].to_pylist()):
                if skel != now:
                    if sha:
                        done[0].append(now)
                        done[1].append(sha.hexdigest())
                    now, sha = skel, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            done[0].append(now)
            done[1].append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int32()), pa.array(done[1], pa.string())], ["skel", "ends_sha256"])

    ends = walked.filter("kind = 'ends'").select("skel", "shard", "block", "ids")
    return ends.repartition("skel").sortWithinPartitions("skel", "shard", "block").select("skel", "ids").mapInArrow(run, "skel int, ends_sha256 string")


def finish_skeleton(walked: DataFrame, skeleton: Skeleton, level: int, first_depth: int) -> tuple[DataFrame, DataFrame]:
    """The skeleton's nodes as WALKED rows, and (skel, parent_conv_id) for the nodes below them.

    Reduced partial aggregates come to the driver: one row per skeleton node,
    of which there are at most MAX_SHARDS times CHUNK_TURNS.
    """
    spark = walked.sparkSession
    parts = walked.filter("kind = 'part'").groupBy("skel").agg(
        F.min("conv_id").alias("low"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("chars").alias("chars"), F.max("at").alias("at"), *[F.max(f"below_{c}").alias(f"below_{c}") for c in ("children", "leaves", "saved")],
    )
    got = {r.skel: r for r in parts.collect()}
    ends = dict(hashed_ends(walked).collect())
    size = len(skeleton.parent)
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    for v in range(1, size):
        kids[skeleton.parent[v]] += 1
    for v in range(size - 1, -1, -1):
        r = got[v]
        if not (level and skeleton.units[v] <= 1):
            saved[v] += (r.n - 1) * r.chars + r.below_saved
            leaves[v] += r.below_leaves if r.below_children else int(r.children + kids[v] == 0)
        if v:
            leaves[skeleton.parent[v]] += leaves[v]
            saved[skeleton.parent[v]] += saved[v]
    fields, rows = [f.split()[0] for f in WALKED.split(", ")], []
    for v in range(size):
        r, up, inner = got[v], skeleton.parent[v], level and skeleton.units[v] <= 1
        if level and v == 0:
            continue
        made = {"kind": "root" if inner else "node", "at": r.at, "n_children": r.children + kids[v] + r.below_children, "n_leaves": r.leaves + leaves[v], "saved_tokens": r.saved + saved[v]}
        if not inner:
            made |= {"conv_id": r.low, "depth": first_depth + skeleton.units[v], "n_convs": r.n, "ends_sha256": ends.get(v, EMPTY_SHA)}
            made |= {"parent_at": got[up].at} if level and skeleton.units[v] == 2 else {"parent_conv_id": got[up].low if up >= 0 else None}
        rows.append(tuple(made.get(f) for f in fields))
    return spark.createDataFrame(rows, WALKED), spark.createDataFrame([(v, got[v].low) for v in range(size)], "skel int, parent_conv_id bigint")


def trie_of(turns: DataFrame, bare: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The trie's nodes (NODE) of turns (conv_id, place, digest, chars) and of conversations without turns, bare (conv_id)."""
    spark = turns.sparkSession
    chunks = stash(chunks_of(turns, bare, chunk_turns), "conversation-chunks")
    levels = chunks.agg(F.max("level")).first()[0]
    if levels is None:
        return spark.createDataFrame([], NODE)
    below = None
    found = []
    for level in range(levels, -1, -1):
        rows = chunks.filter(F.col("level") == level).withColumn("key", F.concat(F.coalesce("at", F.lit(b"")), "path"))
        if below is None:
            rows = rows.select("*", *[F.lit(None).cast("long").alias(f"below_{c}") for c in ("children", "leaves", "saved")])
        else:
            rows = rows.join(below, "next", "left")
        splitters, first_depth = splitters_of(rows), level * chunk_turns - (1 if level else 0)
        walked = stash(walk_shards(rows, splitters, level, first_depth), "conversation-nodes")
        skeleton, names = finish_skeleton(walked, Skeleton(splitters), level, first_depth)
        done = walked.filter("kind in ('node', 'root') and skel is null").unionByName(skeleton)
        under = walked.filter("kind = 'node' and skel is not null").drop("parent_conv_id").join(F.broadcast(names), "skel")
        done = done.unionByName(under.select(*done.columns))
        below = done.filter("kind = 'root'").select(F.col("at").alias("next"), F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"))
        found.append(done.filter("kind = 'node'"))
    fields = [f.split()[0] for f in NODE.split(", ")]
    nodes = found[-1].select(*fields)
    for upper, lower in zip(found[1:], found):  # the names of nodes at which chunks end
        inner = lower.filter("parent_at is null").select(*fields)
        tops = upper.filter("at is not null").select(F.col("at").alias("parent_at"), F.col("conv_id").alias("_parent"))
        joined = lower.filter("parent_at is not null").join(tops, "parent_at").withColumn("parent_conv_id", F.col("_parent"))
        nodes = nodes.unionByName(inner).unionByName(joined.select(*fields))
    return nodes


def prefix_trie(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The trie of all conversations as they are, one row per node (NODE).

    conversations: conv_id, turn, role, text. Turns are ordered by turn (null
    first); ties and repeated rows by a digest of role and text, and each
    stays. A null role or text is empty. Rows without conv_id take no part.
    Other columns are not read. An empty table gives no nodes. A node is a
    distinct sequence of first turns (told apart by 128-bit digests), named by
    its smallest member and its depth.
    """
    turns = stash(numbered(conversations), "conversation-turns")
    return trie_of(turns, turns.select("conv_id").limit(0), chunk_turns)


def query(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations; see rebuilt and prefix_trie."""
    turns = stash(numbered(conversations), "conversation-turns")
    return trie_of(*rebuilt(turns), chunk_turns)


#: op12 for DuckDB: every sequence of first turns by the text of all its turns.
SQL = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, conv_id::VARCHAR AS told FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, told, 1 AS i, 8 AS bits, xor(4294967295::BIGINT, ascii(told[1])::BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, told, CASE WHEN bits > 0 THEN i ELSE i + 1 END, CASE WHEN bits > 0 THEN bits - 1 ELSE 8 END,
    CASE WHEN bits > 0 THEN CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END ELSE xor(c, ascii(told[i + 1])::BIGINT) END
  FROM crc WHERE bits > 0 OR i < length(told)
), heads AS (
  SELECT conv_id, ids.base, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc JOIN ids USING (conv_id) WHERE bits = 0 AND i = length(crc.told)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT h.conv_id, 0 AS own, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.place <= h.h
  UNION ALL SELECT h.conv_id, 1, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.h
), path AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY own, place) OVER w AS seen
  FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
), spots AS (
  SELECT conv_id, depth, chars, seen FROM path UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), lasts AS (SELECT conv_id, max(depth) AS last FROM spots GROUP BY conv_id),
nodes AS (
  SELECT spots.depth, seen, min(conv_id) AS node, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last = spots.depth), '')) AS ends
  FROM spots JOIN lasts USING (conv_id) GROUP BY spots.depth, seen
), steps AS (
  SELECT DISTINCT n.node, n.depth, p.node AS parent FROM nodes n JOIN spots ON spots.conv_id = n.node AND spots.depth = n.depth - 1 JOIN nodes p ON p.depth = spots.depth AND p.seen = spots.seen
), kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM steps GROUP BY ALL),
own AS (
  SELECT n.node, n.depth, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth
), under AS (
  SELECT p.depth, p.seen, sum(leaf) AS leaves, sum(saved) AS saved FROM own JOIN spots p ON p.conv_id = own.node AND p.depth <= own.depth GROUP BY ALL
)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, s.parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM nodes n JOIN under u ON u.depth = n.depth AND u.seen = n.seen LEFT JOIN steps s ON s.node = n.node AND s.depth = n.depth LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth
"""
