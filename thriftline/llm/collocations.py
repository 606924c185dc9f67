"""Phrase collocations by vertical partitioning of a word-level suffix tree.

Every word of a piece begins a suffix, cut to MAX_WORDS words and at words
that are too rare to be in any answer. Suffixes are grouped by prefixes that
the memory budget chooses: one word, or as many more as it takes until a
prefix has no more suffixes than its share (counted in one more scan per
word). Each group builds its subtree by itself from the sorted suffixes; a
node's count is the sum of the leaf totals below it. Nodes above a group's
prefixes were counted by the scans.

Words are told apart as strings; hashes only choose groups and rule rare words
out, where a collision costs room and no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.llm.common import stash

PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
MIN_WORDS, MAX_WORDS, LEAST, TOP, UNKNOWN = 2, 4, 30, 2000, "und"
#: Score of a phrase that never occurs without its parts, and the share (percent) of a phrase's occurrences in a longer one from which on it is dropped.
SCALE, SUBSUMED = 2_000_000, 80
#: Suffixes that a group may hold, bytes of text that a task takes apart at once, most prefixes that are taken further (hashes in a broadcast), and most bits that mark words as frequent.
BUDGET, SLICE_BYTES, MAX_DEEP, MAX_MARK_BITS = 1_000_000, 8 << 20, 1 << 20, 1 << 30

_kind = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: blank, 2: end of a piece
_kind[list(BLANKS)] = 1
_kind[list(PIECE_ENDS)] = 2
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX + more
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


@dataclass
class Words:
    """The words of some texts of one language: distinct ones in order, and for each occurrence its place there, its prefix hash and its piece."""

    lang: str
    distinct: pa.Array
    code: np.ndarray
    piece: np.ndarray

    def __post_init__(self):
        self.hash = mixed(hashes(self.distinct.to_pylist()), hashes([self.lang])[0])


def words_of(lang: str, texts: list[bytes]) -> Words | None:
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)  # texts end pieces
    kind = _kind[raw]
    is_word = kind == 0
    edge = np.diff(is_word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return None
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
    letters, offsets = _lower[raw[is_word]], np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    order = np.asarray(pc.sort_indices(found.dictionary))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return Words(lang, found.dictionary.take(pa.array(order)), rank[np.asarray(found.indices)], piece)


def pieces_apart(text: bytes) -> Iterator[bytes]:
    """text in parts of about SLICE_BYTES, cut at ends of pieces only."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = max(text.rfind(bytes([e]), at, at + SLICE_BYTES) for e in PIECE_ENDS)
        if cut < 0:
            cut = min((f for e in PIECE_ENDS if (f := text.find(bytes([e]), at + SLICE_BYTES)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of all texts (lang, text), some texts of one language at a time."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if not text.is_valid:
                continue
            for part in pieces_apart(bytes(text.as_buffer())):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                total += len(part) + 1
            if total > SLICE_BYTES:
                largest = max(sizes, key=sizes.get)
                total -= sizes.pop(largest)
                if found := words_of(largest, held.pop(largest)):
                    yield found
    for lang in held:
        if found := words_of(lang, held[lang]):
            yield found


def counted(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f): occurrences of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in slices(batches):
            n = np.bincount(w.code, minlength=len(w.distinct))
            yield pa.RecordBatch.from_arrays([pa.array([w.lang] * len(n), pa.string()), w.distinct.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Marks:
    """Bits by hash; has no false no."""

    def __init__(self, n: int):
        self.size = 1 << min(MAX_MARK_BITS.bit_length() - 1, max(10, (32 * n).bit_length()))
        self.bits = np.zeros(self.size >> 3, dtype=np.uint8)

    def places(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.size - 1)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def marked(words: DataFrame, n: int) -> Marks:
    """Marks of the n words (lang, phrase). The driver gets the bits, in blocks; they take MAX_MARK_BITS at most."""
    marks, block = Marks(n), 1 << 20

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = marks.places(mixed(hashes(b.phrase.tolist()), hashes(b.lang.tolist())))
            yield pd.DataFrame({"block": (at // block).astype(np.int32), "bit": (at % block).astype(np.int32)})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(block, dtype=np.uint8)
        bits[rows.bit.to_numpy()] = 1
        return pd.DataFrame({"block": rows.block.iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    placed = words.select("lang", "phrase").mapInPandas(places, "block int, bit int").distinct()
    for r in placed.groupBy("block").applyInPandas(gather, "block int, bits binary").toLocalIterator():
        at, bits = r.block * (block >> 3), np.frombuffer(r.bits, dtype=np.uint8)
        marks.bits[at : at + len(bits)] = bits[: len(marks.bits) - at]
    return marks


@dataclass
class Cut:
    """How suffixes are cut and dealt: marks of frequent words, and by number of words the sorted hashes of prefixes that are taken further."""

    marks: Marks
    deep: list[np.ndarray]

    def suffixes(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the suffixes of two words or more: codes (a row each, -1 where it has ended), prefix hash at their group's prefix, its number of words, and how many words the suffix has."""
        frequent = self.marks.holds(w.hash)[w.code]
        n = len(w.code)
        long = np.zeros(n, dtype=np.int8)
        going = frequent.copy()
        for k in range(MAX_WORDS):
            long[: n - k] += going[: n - k] if k else going
            if k + 1 < MAX_WORDS:
                step = np.zeros(n, dtype=bool)
                m = n - k - 1
                if m > 0:
                    step[:m] = going[:m] & frequent[k + 1 :] & (w.piece[:m] == w.piece[k + 1 :])
                going = step
        at = np.flatnonzero(long >= MIN_WORDS)
        long = long[at]
        codes = np.full((len(at), MAX_WORDS), -1, dtype=np.int64)
        for k in range(MAX_WORDS):
            here = long > k
            codes[here, k] = w.code[at[here] + k]
        h, level, on = w.hash[codes[:, 0]], np.ones(len(at), dtype=np.int8), np.ones(len(at), dtype=bool)
        for k in range(1, MAX_WORDS):
            on = on & is_in(h, self.deep[k - 1]) if len(self.deep) >= k else np.zeros(len(at), dtype=bool)
            if not on.any():
                break
            level[on] += 1
            more = on & (long > k)
            h = h.copy()
            h[more] = mixed(h[more], w.hash[codes[more, k]])
        return codes, h, level, long


def is_in(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(h), dtype=bool)
    return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, the first one first, and where in it a new combination begins."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(fresh)


def told(w: Words, codes: np.ndarray) -> pa.Array:
    """Rows of codes as phrases: words with a space between."""
    words = w.distinct.cast(pa.string())
    columns = [words.take(pa.array(codes[:, k], pa.int64(), mask=codes[:, k] < 0)) for k in range(codes.shape[1])]
    return pc.binary_join_element_wise(*columns, " ", null_handling="skip")


def packed(codes: np.ndarray) -> list[np.ndarray]:
    """Keys that order rows of codes as their columns do."""
    return [(codes[:, k] + 1 << 31) + (codes[:, k + 1] + 1 if k + 1 < codes.shape[1] else 0) for k in range(0, codes.shape[1], 2)]


def extended(texts: DataFrame, cut: Cut, depth: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of depth words whose first depth - 1 words are a prefix taken further: one more scan."""
    shared = texts.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in slices(batches):
            codes, _, level, long = shared.value.suffixes(w)
            codes = codes[(level >= depth) & (long >= depth), :depth]
            order, first = runs(*packed(codes))
            n = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array([w.lang] * len(n), pa.string()), told(w, codes[order[first]]), pa.array(n, pa.int64())], ["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_hashes(rows: DataFrame) -> np.ndarray:
    """Sorted prefix hashes of the phrases of rows (lang, phrase), of which there are at most MAX_DEEP."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, lang = b.phrase.str.split(" ").tolist(), hashes(b.lang.tolist())
            h = mixed(hashes([p[0] for p in words]), lang)
            for k in range(1, len(words[0]) if words else 0):
                h = mixed(h, mixed(hashes([p[k] for p in words]), lang))
            yield pd.DataFrame({"h": h.view(np.int64)})

    found = rows.select("lang", "phrase").mapInPandas(run, "h bigint").toArrow()["h"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def dealt(texts: DataFrame, cut: Cut, groups: int) -> DataFrame:
    """(grp, level, lang, phrases, counts): suffixes by group, those of a slice and group in one row; level is the length of their group's prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in slices(batches):
            codes, h, level, _ = shared.value.suffixes(w)
            group = (mixed(h, np.uint64(7)) % np.uint64(groups)).astype(np.int64)
            order, first = runs(group * MAX_WORDS + level, *packed(codes))
            if not len(order):
                continue
            n, at = np.diff(np.append(first, len(order))).astype(np.int32), order[first]
            key = group[at] * MAX_WORDS + level[at]
            rows = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), told(w, codes[at])), "\n")
            counts = [n[a:b].tobytes() for a, b in zip(rows, rows[1:])]
            begins = at[rows[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[begins], pa.int32()), pa.array(level[begins], pa.int32()), pa.array([w.lang] * len(begins), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.binary())],
                ["grp", "level", "lang", "phrases", "counts"],
            )

    return texts.mapInArrow(run, "grp int, level int, lang string, phrases string, counts binary")


def subtree(least: int) -> Callable[[pa.Table], pa.Table]:
    """Builds the subtree of a group and gives the phrases of two words or more that its nodes stand for and that occur least times."""

    def build(rows: pa.Table) -> pa.Table:
        phrases, out = rows["phrases"], ([], [], [])
        suffixes = pc.list_flatten(pc.split_pattern(phrases, "\n")).combine_chunks()
        n = np.concatenate([np.frombuffer(c, dtype=np.int32) for c in rows["counts"].to_pylist()]).astype(np.int64)
        per = np.array([len(c) // 4 for c in rows["counts"].to_pylist()])
        level = np.repeat(rows["level"].to_numpy(), per)
        langs = rows["lang"].combine_chunks().dictionary_encode()
        lang = np.repeat(np.asarray(langs.indices), per).astype(np.int64)
        split = pc.split_pattern(suffixes, " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        flat = split.values.dictionary_encode()
        code, long, words = np.asarray(flat.indices).astype(np.int64), np.diff(offsets), flat.dictionary
        codes = np.full((len(long), MAX_WORDS), -1, dtype=np.int64)
        for k in range(MAX_WORDS):
            here = long > k
            codes[here, k] = code[offsets[:-1][here] + k]
        order = np.lexsort((*(codes[:, k] for k in range(MAX_WORDS - 1, -1, -1)), lang))
        codes, lang, level, n = codes[order], lang[order], level[order], n[order]
        fresh = np.zeros(len(n), dtype=bool)
        fresh[:1] = True
        fresh[1:] = (lang[1:] != lang[:-1]) | (codes[1:, 0] != codes[:-1, 0])
        for depth in range(MIN_WORDS, MAX_WORDS + 1):
            fresh[1:] |= codes[1:, depth - 1] != codes[:-1, depth - 1]
            first = np.flatnonzero(fresh)
            f = np.add.reduceat(n, first) if len(first) else n[:0]
            keep = (f >= least) & (codes[first, depth - 1] >= 0) & (level[first] <= depth)
            at = first[keep]
            columns = [words.take(pa.array(codes[at, k])) for k in range(depth)]
            out[0].append(langs.dictionary.take(pa.array(lang[at])))
            out[1].append(pc.binary_join_element_wise(*columns, " "))
            out[2].append(pa.array(f[keep], pa.int64()))
        return pa.table([pa.chunked_array(c) for c in out], ["lang", "phrase", "f"])

    return build


def frequent_phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to MAX_WORDS words that occur least times, and (lang, n): all words of a language."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text"))
    every = stash(counted(texts), "word-counts")
    totals = every.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    words = every.filter(F.col("f") >= least)
    n_words, total = words.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    cut = Cut(marked(words, n_words), [])
    share = max(budget // 8, -(-int(total) // MAX_DEEP))  # a prefix with more suffixes is taken further
    level, found = words, [words]
    for depth in range(1, MAX_WORDS):
        over = level.filter(F.col("f") > share)
        if over.isEmpty():
            break
        cut = Cut(cut.marks, [*cut.deep, phrase_hashes(over)])
        if depth + 1 < MAX_WORDS:
            level = stash(extended(texts, cut, depth + 1).filter(F.col("f") >= least), "phrase-counts")
            found.append(level)
    groups = max(1, -(-2 * int(total) // budget))
    nodes = dealt(texts, cut, groups).groupBy("grp").applyInArrow(subtree(least), "lang string, phrase string, f bigint")
    return stash(_union([*found, nodes]).distinct(), "phrases"), totals


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def first_words(phrase: Column, k: Column) -> Column:
    return F.substring_index(phrase, " ", k)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends,
    and into words at spaces and tabs. A phrase of 2 to 4 words that occurs
    a >= least times within pieces is a candidate; of its cuts into two parts
    that occur l and r times, the one of least score SCALE * a / (l + r),
    rounded down, counts (ties: the shorter first part). It is dropped if a
    longer candidate holds it and occurs at least SUBSUMED percent as often.
    n counts all words of the language. Ranks go by score, then a, both
    descending, then phrase by its bytes.

    A null text has no words; a null lang is `und`. doc_id and other columns
    are not read: repeated rows count as often as they come. An empty table
    gives no rows. A piece longer than SLICE_BYTES is taken apart as a whole.
    """
    phrases, totals = frequent_phrases(docs, least, budget)
    size = F.size(F.split("phrase", " "))
    candidates = phrases.select("lang", "phrase", F.col("f").alias("a"), size.alias("size")).filter(F.col("size") >= MIN_WORDS)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("part1", F.expr("array_join(slice(split(phrase, ' '), 1, k), ' ')")).withColumn("part2", F.expr("array_join(slice(split(phrase, ' '), k + 1, size - k), ' ')"))
    of = lambda part, out: phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(out))
    cuts = cuts.join(of("part1", "l"), ["lang", "part1"]).join(of("part2", "r"), ["lang", "part2"])
    cuts = cuts.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0)) div (CAST(l AS DECIMAL(18,0)) + CAST(r AS DECIMAL(18,0)))").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = candidates.filter(F.col("size") > MIN_WORDS).withColumn("s", F.explode(F.expr(f"flatten(transform(sequence({MIN_WORDS}, size - 1), w -> transform(sequence(1, size - w + 1), i -> array_join(slice(split(phrase, ' '), i, w), ' '))))")))
    inner = inner.groupBy("lang", F.col("s").alias("phrase")).agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SUBSUMED))
    kept = kept.join(totals, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # a rank's limit is pruned before rows are shuffled
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


#: op11 for DuckDB: every phrase of every piece spelled out and counted.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
g AS (SELECT lang, k, array_to_string(ws[pos : pos + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE pos + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
v AS (
  SELECT u.lang, u.phrase, a, cut, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM v),
s AS (
  SELECT lang, array_to_string(ws[pos : pos + size - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k)) AS pos FROM c WHERE k > 2), (SELECT unnest([2, 3]) AS size)
  WHERE size < k AND pos + size - 1 <= k GROUP BY ALL
), t AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase
  WHERE o = 1 AND NOT coalesce(100 * longer >= 80 * a, false)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
