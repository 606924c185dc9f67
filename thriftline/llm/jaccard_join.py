"""Exact similarity join of documents on the Jaccard similarity of their word n-grams, by set relations.

Equal sets are one class, searched once. Shingles have one order for all sets:
longer ones first, frequent ones last. Two sets that link share a shingle among
the first |x| - ceil(t |x|) + 1 of each (their prefixes), and before the first
that they share at most |x| + |y| - 2 * (least overlap) shingles differ.

1. A first round pairs the sets that share one of their first few shingles with
   one pivot per shingle. Its links make components.
2. Index lists (one per prefix shingle) give the other pairs. A list whose sets
   are in one component already can add nothing and is skipped. A frequent one
   is dealt into parts, and each two parts meet in a group of their own, so no
   task holds more than two parts. A group is cut into blocks by size and
   position; blocks whose sizes or positions rule a link out are skipped. Parity
   sketches rule out most pairs that are left.
3. Each set's nearest candidates are verified first. Sets that they link take
   over each other's answers: a pair of sets in one component by now needs no
   answer, and one whose leaders (the linked sets nearest to them) have a known
   difference is settled where the triangle inequality on differences rules a
   link out. Only the others are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from thriftline.llm.common import join_heavy, stash
from thriftline.llm.graph import components

FIRST_SHINGLES, NEAREST = 8, 2
BLOCK = 64
SET_ROWS = 200
#: The order of shingles comes from one in SAMPLE documents: frequent are those in one in FREQUENT_SHARE of them, or in
#: FREQUENT_MOST; in FREQUENT_LEAST at least, and the MAX_FREQUENT most frequent ones. It steers the cost only; links do not depend on it.
SAMPLE, FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST, MAX_FREQUENT = 16, 2000, 4, 256, 1_000_000
#: Entries to a part of a frequent shingle's list, and candidate pairs that are looked at together.
LIST_PART, PAIR_ROWS = 4096, 1 << 18
#: Up to so many ids are broadcast, more are shuffled; either way gives the same rows.
MAX_BROADCAST_IDS = 1_000_000
#: Bits of a set's parity sketch: a power of two, twice its size at least, within these bounds. Each shingle flips one, so
#: two sketches differ in no more bits than the sets in shingles. A longer one folds to half by xor of its halves.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 1024, 1 << 16
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Measure:
    """n-grams of words; sets link when den * intersection >= num * union."""

    n: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def linked(self, inter: Column, a: Column, b: Column) -> Column:
        return inter * (self.num + self.den) >= (a + b) * self.num

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def slack(self, a, b):
        """Most shingles by which linked sets of these sizes differ; for numbers, arrays and columns."""
        return (a + b) - 2 * (((a + b) * self.num + self.num + self.den - 1) // (self.num + self.den))

    def slack_column(self, a: Column, b: Column) -> Column:
        return (a + b) - 2 * F.ceil((a + b) * self.num / (self.num + self.den))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a whole text as sorted 64-bit hashes, and their lengths. bytes.lower and bytes.split know ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < n:
        words, n = [b" ".join(words)], 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    m = len(words) - n + 1
    code, length = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for i in range(n):
        code = mixed(code * ODD[1] + h[i : m + i])
        length += size[i : m + i]
    code, first = np.unique(code.view(np.int64), return_index=True)
    return code, length[first]


def parity_sketch(code: np.ndarray) -> np.ndarray:
    bits = LEAST_SKETCH_BITS
    while bits < min(2 * len(code), MOST_SKETCH_BITS):
        bits *= 2
    at = (mixed(code.view(np.uint64) * ODD[0]) >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def sets_of(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(key, shingles array<bigint>), in small batches: a long document's set takes more room than its text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SET_ROWS):
                part = b.slice(lo, SET_ROWS)
                sets = [shingles(t, n)[0] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=[key, "shingles"])

    return docs.select(key, "text").mapInArrow(made, T.StructType([docs.schema[key], T.StructField("shingles", T.ArrayType(T.LongType()))]))


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    least = max(FREQUENT_LEAST, min(FREQUENT_MOST, sample.count() // FREQUENT_SHARE))
    counted = sets_of(sample, n).select(F.explode("shingles").alias("s")).groupBy("s").count().filter(F.col("count") >= least)
    return np.sort(counted.orderBy(F.desc("count"), "s").limit(MAX_FREQUENT).select("s").toArrow()["s"].to_numpy())


def sketched(docs: DataFrame, measure: Measure) -> DataFrame:
    """(doc_id, text_hash, size, s1, s2, prefix, sketch, rare): size and signature of each set, its prefix in the common order (the first `rare` are not frequent), and its parity sketch."""
    held = docs.sparkSession.sparkContext.broadcast((frequent_shingles(docs, measure.n), measure))

    @F.pandas_udf("size bigint, s1 bigint, s2 bigint, prefix array<bigint>, sketch array<bigint>, rare int")
    def made(texts: pd.Series) -> pd.DataFrame:
        frequent, m = held.value
        out = []
        for text in texts:
            code, length = shingles(text, m.n)
            raw = code.view(np.uint64)
            signature = [int(mixed(raw * k).sum(dtype=np.uint64).astype(np.int64)) for k in ODD[1:]]
            common = np.zeros(len(code), bool)
            if len(frequent):
                common = frequent[np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)] == code
            order = np.lexsort((code, -length, common))[: m.prefix(len(code))] if len(code) else []
            out.append((len(code), *signature, code[order] if len(code) else code, parity_sketch(code), int((~common[order]).sum()) if len(code) else 0))
        return pd.DataFrame(out, columns=["size", "s1", "s2", "prefix", "sketch", "rare"])

    return docs.select("doc_id", text_hash().alias("text_hash"), made("text").alias("m")).select("doc_id", "text_hash", "m.*")


def text_hash() -> Column:
    return F.xxhash64("text")


@dataclass(frozen=True)
class Texts:
    """Where the text of a class is found: in a row of docs with its doc_id and text_hash. repeated: several rows may have both."""

    docs: DataFrame
    reps: DataFrame
    repeated: bool

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of classes ids (id)."""
        found = stash(self.reps.select("id", "doc_id", "text_hash").join(ids, "id", "left_semi"), "paired-ids")
        few = found.count() <= MAX_BROADCAST_IDS
        texts = self.docs.select("doc_id", "text", text_hash().alias("text_hash")).join(F.broadcast(found) if few else found, ["doc_id", "text_hash"]).select("id", "text")
        return texts.dropDuplicates(["id"]) if self.repeated else texts


def common_shingles(pairs: DataFrame, texts: Texts, measure: Measure) -> DataFrame:
    """pairs (a, b, ...) with inter, the number of shingles that a and b share. Only the texts of classes in pairs are read again."""
    sets = sets_of(texts.of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), measure.n, "id")
    got = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    return got.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"))


def plausible(pairs: DataFrame, reps: DataFrame, measure: Measure) -> DataFrame:
    """pairs (a, b, na, nb) whose sketches do not rule a link out, with bits, in which they differ."""
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("id").alias(side), F.col("sketch").alias(f"_{side}")), side)
    words = F.least(F.size("_a"), F.size("_b"))

    def fold(x: str) -> Column:  # linked sizes are within a factor of two, and so are their sketches; others fold as far as one step takes them
        return F.when(F.size(x) == words, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.get(x, i).bitwiseXOR(F.get(x, i + words))))

    differing = F.aggregate(F.zip_with(fold("_a"), fold("_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = pairs.withColumn("bits", differing)
    return pairs.filter(F.col("bits") <= measure.slack_column(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb", "bits")


def pivot_pairs(reps: DataFrame, measure: Measure) -> DataFrame:
    """(a, b, na, nb): each set with one pivot for each of its first shingles; the pivot is drawn by hash, anew for each shingle."""
    rows = reps.select("id", "size", F.explode(F.slice("prefix", 1, FIRST_SHINGLES)).alias("s"))
    pivots = rows.groupBy("s").agg(F.min(F.struct(F.xxhash64("id", "s").alias("h"), "id", "size")).alias("p"), F.count("*").alias("n")).filter("n > 1")
    pairs = rows.join(pivots, "s").filter(F.col("id") != F.col("p.id")).filter(measure.sizes_fit(F.col("size"), F.col("p.size")))
    swap = F.col("id") > F.col("p.id")
    one, two = F.struct("id", "size"), F.struct("p.id", "p.size")
    pairs = pairs.select(F.when(swap, two).otherwise(one).alias("x"), F.when(swap, one).otherwise(two).alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb")).distinct()


def short_list_pairs(group: np.ndarray, size: np.ndarray, pos: np.ndarray, comp: np.ndarray, deal: np.ndarray, measure: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of candidate pairs in groups that follow one another, each sorted by size; all groups advance together."""
    left, step = np.arange(len(group)), 1
    while len(left):
        left = left[left + step < len(group)]
        right = left + step
        left = left[(group[right] == group[left]) & (size[right] * measure.num <= size[left] * measure.den)]  # sizes only grow in a group
        right = left + step
        fit = (comp[left] != comp[right]) & (pos[left] + pos[right] <= measure.slack(size[left], size[right])) & ((deal[left] < 0) | (deal[left] != deal[right]))
        yield left[fit], right[fit]
        step += 1


def long_list_pairs(size: np.ndarray, pos: np.ndarray, comp: np.ndarray, deal: np.ndarray, measure: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of candidate pairs in one group sorted by size, by blocks."""
    if (comp == comp[0]).all():
        return
    for x in range(0, len(size), BLOCK):
        a = slice(x, x + BLOCK)
        for y in range(x, len(size), BLOCK):
            b = slice(y, y + BLOCK)
            if size[y] * measure.num > size[a][-1] * measure.den:
                break  # sizes only grow
            if pos[a].min() + pos[b].min() > measure.slack(size[a][-1], size[b][-1]):
                continue  # the block is too far down the list
            na, nb = size[a][:, None], size[b][None, :]
            fit = (na * measure.den >= nb * measure.num) & (pos[a][:, None] + pos[b][None, :] <= measure.slack(na, nb)) & (comp[a][:, None] != comp[b][None, :])
            fit &= (deal[a][:, None] < 0) | (deal[a][:, None] != deal[b][None, :])
            p, q = np.nonzero(np.triu(fit, 1) if x == y else fit)
            yield x + p, y + q


def list_pairs(lists: DataFrame, measure: Measure) -> DataFrame:
    """(a, b, na, nb) from index lists (s, part, deal, id, size, pos, comp, sketch), of different components only.

    Entries with the same s and part are a group. Where deal is not negative,
    only entries with different ones pair up. Where two entries have sketches,
    these must not rule the pair out.
    """
    numbers = ["size", "pos", "comp", "deal"]

    def sketched_pairs(g: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        words = np.array([0 if x is None else len(x) for x in g["sketch"]])
        width = np.minimum(words[p], words[q])
        ok = np.ones(len(p), bool)
        for w in np.unique(width[width > 0]).tolist():
            same = np.flatnonzero(width == w)
            for lo in range(0, len(same), max(1, (1 << 20) // w)):  # bounds the memory of the sketches side by side
                at = same[lo : lo + max(1, (1 << 20) // w)]
                x, y = (np.stack([folded(v, w) for v in g["sketch"][i[at]]]) for i in (p, q))
                ok[at] = np.bitwise_count((x ^ y).view(np.uint64)).sum(1, dtype=np.int64) <= measure.slack(g["size"][p[at]], g["size"][q[at]])
        return ok

    def candidates(g: dict[str, np.ndarray], ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        long = np.diff(ends) > 2 * BLOCK
        at = np.flatnonzero(np.repeat(~long, np.diff(ends)))
        group = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[at]
        for p, q in short_list_pairs(group, *(g[c][at] for c in numbers), measure):
            yield at[p], at[q]
        for lo, hi in zip(ends[:-1][long], ends[1:][long]):
            for p, q in long_list_pairs(*(g[c][lo:hi] for c in numbers), measure):
                yield lo + p, lo + q

    def pairs_of(g: dict[str, np.ndarray], ends: np.ndarray) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def kept() -> pd.DataFrame:
            p, q = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            ok = sketched_pairs(g, p, q)
            p, q = p[ok], q[ok]
            swap = g["id"][p] > g["id"][q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            return pd.DataFrame({"a": g["id"][p], "b": g["id"][q], "na": g["size"][p], "nb": g["size"][q]}).drop_duplicates()

        for found in candidates(g, ends):
            held.append(found)
            n += len(found[0])
            if n >= PAIR_ROWS:
                yield kept()
                held, n = [], 0
        if held:
            yield kept()

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            cols = {c: batch[c].to_numpy() for c in batch.columns}
            if rest is not None:
                cols = {c: np.concatenate([rest[c], cols[c]]) for c in cols}
            ends = np.array([0, *(np.flatnonzero((np.diff(cols["s"]) != 0) | (np.diff(cols["part"]) != 0)) + 1)])
            if len(ends) > 1:  # the last group may go on in the next batch
                yield from pairs_of({c: v[: ends[-1]] for c, v in cols.items()}, ends)
            rest = {c: v[ends[-1] :] for c, v in cols.items()}
        if rest is not None and len(rest["s"]):
            yield from pairs_of(rest, np.array([0, len(rest["s"])]))

    placed = lists.select("s", "part", "deal", "id", "size", "pos", "comp", "sketch").repartition("s", "part").sortWithinPartitions("s", "part", "size")
    return placed.mapInPandas(joined, "a bigint, b bigint, na bigint, nb bigint").distinct()


def dealt(frequent: DataFrame, several: DataFrame) -> DataFrame:
    """Entries of frequent lists with part and deal: a list of several parts (s, parts) comes as a group for each two of them.

    A group of one part with itself pairs all its entries (deal -1), one of two
    parts only those of different parts.
    """
    mine = F.pmod(F.xxhash64("id", "s"), F.col("parts")).cast("long")
    rows = frequent.join(several, "s").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    part = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
    return rows.withColumn("part", part).withColumn("deal", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).cast("long")).drop("parts", "mine", "other")


def shortened(rare: DataFrame, named: DataFrame) -> DataFrame:
    """Entries of rare shingles' lists, but lists that have turned out long are dealt into parts like frequent ones, with sketches."""
    long = rare.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter(F.col("n") > LIST_PART)
    long = stash(long.select("s", (F.col("lo") != F.col("hi")).alias("mixed"), F.ceil(F.col("n") / LIST_PART).alias("parts")), "long-lists")
    if long.isEmpty():
        return rare
    entries = named.select("comp", "id", "size", "sketch", F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("pos", "s"))
    return rare.join(long, "s", "left_anti").select(*rare.columns).unionByName(dealt(entries, long.filter("mixed").select("s", "parts")).select(*rare.columns))


def with_component(rows: DataFrame, ids: DataFrame, col: str, out: str) -> DataFrame:
    """rows with the component of col; an id without links is its own."""
    named = ids.select(F.col("id").alias("_id"), F.col("component").alias("_c"))
    return rows.join(named, F.col(col) == F.col("_id"), "left").withColumn(out, F.coalesce("_c", col)).drop("_id", "_c")


def find_links(reps: DataFrame, docs: Texts, measure: Measure) -> DataFrame:
    """(a, b): links of sets reps (id, size, prefix, sketch, rare) that connect whatever all links would."""
    linked = measure.linked(F.col("inter"), F.col("na"), F.col("nb"))
    first = plausible(pivot_pairs(reps, measure), reps, measure).select("a", "b", "na", "nb")
    answers = stash(common_shingles(stash(first, "pivot-pairs"), docs, measure), "pivot-answers")
    comps = stash(components(answers.filter(linked).select("a", "b")), "components")

    # lists of frequent shingles may hold any share of the sets: those within one component go before they are dealt
    # out, and the others bring sketches, which rule most pairs out where they meet
    named = with_component(reps, comps, "id", "comp").select("comp", "id", "size", "sketch", "rare", "prefix")
    rare = named.select(F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("deal"), "comp", "id", "size", F.lit(None).cast("array<bigint>").alias("sketch"), F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("pos", "s"))
    frequent = named.filter(F.col("rare") < F.size("prefix")).select("comp", "id", "size", "sketch", "rare", F.posexplode(F.slice("prefix", F.col("rare") + 1, F.size("prefix"))).alias("p", "s"))
    frequent = frequent.select("comp", "id", "size", "sketch", (F.col("p") + F.col("rare")).alias("pos"), "s")
    several = frequent.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("s", F.ceil(F.col("n") / LIST_PART).alias("parts"))
    # MAX_FREQUENT shingles at most are frequent, so several may be broadcast
    lists = shortened(rare, named).unionByName(dealt(frequent, F.broadcast(several)))
    pairs = stash(plausible(list_pairs(lists, measure), reps, measure), "list-pairs")
    if pairs.isEmpty():
        return answers.filter(linked).select("a", "b")

    # the nearest candidates of each set, by sketch
    ends = pairs.select("*", F.explode(F.array("a", "b")).alias("id"))
    near = ends.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("bits", "a", "b"))).filter(F.col("n") <= NEAREST)
    near = near.select("a", "b", "na", "nb").distinct().join(answers.select("a", "b"), ["a", "b"], "left_anti")
    answers = stash(answers.unionByName(common_shingles(stash(near, "near-pairs"), docs, measure)), "answers")
    links = answers.filter(linked).select("a", "b")
    comps = stash(components(links), "components")

    left = pairs.select("a", "b", "na", "nb").join(answers.select("a", "b"), ["a", "b"], "left_anti")
    left = with_component(with_component(left, comps, "a", "ca"), comps, "b", "cb").filter("ca <> cb").select("a", "b", "na", "nb")
    left = stash(settled_by_leaders(left, answers, linked, measure), "open-pairs")
    if left.isEmpty():
        return links
    return links.unionByName(common_shingles(left, docs, measure).filter(linked).select("a", "b"))


def settled_by_leaders(pairs: DataFrame, answers: DataFrame, linked: Column, measure: Measure) -> DataFrame:
    """pairs (a, b, na, nb) without those that their leaders' known difference rules out.

    A set's leader is the linked set of least difference d, or itself. With D
    the difference of two leaders, their followers differ in D - d - d' at
    least.
    """
    known = answers.withColumn("d", F.col("na") + F.col("nb") - 2 * F.col("inter"))
    both = known.filter(linked).select(F.explode(F.array(F.struct(F.col("a").alias("id"), "d", F.col("b").alias("leader")), F.struct(F.col("b").alias("id"), "d", F.col("a").alias("leader")))).alias("x")).select("x.*")
    leaders = both.groupBy("id").agg(F.min(F.struct("d", "leader")).alias("l"))
    for side in ("a", "b"):
        named = leaders.select(F.col("id").alias(side), F.col("l").alias(f"l{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", F.struct(F.lit(0).cast("long").alias("d"), F.col(side).alias("leader"))))
    known = known.select(F.col("a").alias("_x"), F.col("b").alias("_y"), "d")
    pairs = pairs.join(known, (F.least("la.leader", "lb.leader") == F.col("_x")) & (F.greatest("la.leader", "lb.leader") == F.col("_y")), "left")
    least = F.coalesce("d", F.lit(0)) - F.col("la.d") - F.col("lb.d")
    return pairs.filter(least <= measure.slack_column(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")


def similarity_groups(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included. A
    text with fewer than n words has its whole sequence as one shingle; one
    without words, or null, has none and links with nothing. Rows with the
    same doc_id are one node, which links by any of its texts. A null doc_id
    links with nothing and has a null component. Ties need no rule: the groups
    are unique. Empty tables give none. Shingles are compared by 64-bit hashes,
    sets by 128 bits.
    """
    docs, same = docs.select("doc_id", "text"), ["size", "s1", "s2"]
    rows = stash(sketched(docs, measure).withColumn("id", F.monotonically_increasing_id()), "sets")
    is_used = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    used = rows.filter(is_used)
    # one row stands for each set; its id names the class, as doc_ids may repeat
    first = F.min_by(F.struct("id", "doc_id", "text_hash", "prefix", "sketch", "rare"), "id").alias("r")
    reps = used.groupBy(*same).agg(first, F.count("*").alias("n"), F.min("doc_id").alias("low")).select(*same, "n", "low", "r.*")
    reps = stash(reps, "classes")
    repeated = not used.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    links = find_links(reps, Texts(docs, reps, repeated), measure).unionByName(links_of_one_id(used, reps, same))
    comps = stash(components(links), "components")
    of = reps.select("id", "low").join(comps, "id")
    lowest = of.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n_classes"))
    of = join_heavy(of, lowest, ["component"], "n_classes", reps.count()).select("id", "component_id")
    classes = reps.select(*same, "n", "id", "low").join(of, "id", "left").select(*same, "n", F.coalesce("component_id", "low").alias("component_id"))
    out = join_heavy(used.select("doc_id", *same), classes, same, "n", rows.count()).select("doc_id", "size", "component_id")
    out = out.unionByName(rows.filter(~is_used).select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def links_of_one_id(used: DataFrame, reps: DataFrame, same: list[str]) -> DataFrame:
    """(a, b): links between the classes of rows with one doc_id."""
    kind = F.struct(*same)
    several = used.groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).filter("lo <> hi").select("doc_id")
    found = used.select("doc_id", *same).join(several, "doc_id", "left_semi").distinct().join(reps.select(*same, "id"), same).select("doc_id", "id")
    return found.join(found.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").filter("a <> id").select("a", F.col("id").alias("b"))


#: For near copies where no contract says otherwise.
NEAR_COPIES = Measure(5, 80, 100)


def one_of_each_group(docs: DataFrame, measure: Measure = NEAR_COPIES) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id's. docs: doc_id, text and any other columns, which pass through.

    Rows of one doc_id with equal texts are copies too, and one of them stays
    (any, if other columns differ); with different texts each stays if its
    group has no smaller doc_id. Rows without doc_id can't be named by a group:
    one of those with equal texts stays, unless a row with a doc_id has that
    text. A null text is a text of its own here, an empty one is too; neither
    is in a group with others. An empty table gives no rows.
    """
    extra = similarity_groups(docs, measure).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(stash(extra, "copies").hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    key = [F.xxhash64("text").alias("_h1"), F.xxhash64("text", F.lit(1)).alias("_h2")]
    # copies of a row are few or none: only theirs, and rows without doc_id, are looked at again
    texts = docs.select("doc_id", *key)
    twice = stash(texts.groupBy("doc_id", "_h1", "_h2").count().filter("count > 1").select("doc_id", "_h1", "_h2").unionByName(texts.filter("doc_id is null")).distinct(), "repeated-rows")
    if twice.isEmpty():
        return kept
    named = twice.filter("doc_id is null").join(texts.filter("doc_id is not null"), ["_h1", "_h2"], "left_semi").select("_h1", "_h2").distinct()
    rows = kept.select("*", *key)
    same = [rows["doc_id"].eqNullSafe(twice["doc_id"]), rows["_h1"] == twice["_h1"], rows["_h2"] == twice["_h2"]]
    single, several = rows.join(twice, same, "left_anti"), rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"])
    without = several.filter("doc_id is null").join(named, ["_h1", "_h2"], "left_anti")
    return single.select(*docs.columns).unionByName(several.filter("doc_id is not null").select(*docs.columns)).unionByName(without.select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return similarity_groups(docs)


#: op7 for DuckDB: sets that share a shingle, linked by an inverted list of all shingles.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), c AS (SELECT min(doc_id) AS rep, k AS s, len(k) AS n FROM (SELECT doc_id, list_sort(s) AS k FROM s WHERE len(s) > 0) GROUP BY k
), i AS (SELECT rep, n, unnest(s) AS t FROM c
), e AS (
  SELECT a.rep AS a, b.rep AS b FROM i a JOIN i b ON a.t = b.t AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.rep, b.rep HAVING count(*) * 190 >= 90 * (any_value(a.n) + any_value(b.n))
), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT rep AS root, rep AS node FROM c UNION SELECT root, b FROM r JOIN g ON node = a
), m AS (SELECT node, min(root) AS comp FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = list_sort(s.s) LEFT JOIN m ON m.node = c.rep
"""
