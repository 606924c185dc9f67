"""Exact top-k search by BM25 over sharded inverted indexes, with block-max WAND pruning.

Document frequencies, the number of documents and their mean length are counted
over all rows first, so scores of different shards compare and the merged top k
is exact. Shards (a bounded number of postings each) are built once and written
to the shared folder; blocks of queries then meet them there, so neither the
index nor a query passes through the driver or is shuffled.

A shard's documents are of one kind (they share words, as those of a language
do) and stand by length, so that few of its block maxima are high for queries
of another kind, and those that are fit the documents closely. Kinds are
learned from the first documents of a task; results do not depend on them.

A shard's lists are cut into blocks by document range, each with its largest
impact. For one query and one range of documents, take the query's terms from
the largest bound down: the pivot is the last term from which on the block
maxima still sum to the k-th best score. A document of the range that holds
none of the terms up to the pivot cannot enter the top k (WAND's pivot test,
with block maxima), so the blocks of the terms behind it are skipped; ranges
without a pivot are skipped whole. Where most ranges of a shard have one, whole
lists are read instead of blocks, and the most frequent terms of all such
queries are added up in one product. Documents whose sum may be among the k
best are scored in full.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.llm.common import LARGE, MEETING, join_heavy, meet, stash

K, K1, B = 10, 1.2, 0.75
#: A shard's postings (more only where one document has more) and documents; documents to a range; terms to a block of queries.
SHARD_POSTINGS, SHARD_DOCS, BLOCK_DOCS, BLOCK_TERMS = 1 << 20, 1 << 15, 128, 1 << 20
#: Kinds of documents that a task tells apart when it cuts shards, by so many terms; shards that it fills at once; those that it makes, where cores do not idle.
KINDS, KIND_TERMS, KIND_TURNS, HELD_SHARDS, TASK_BUILDS = 8, 256, 12, 3, 16
#: Scores are compared to this many places, so that the order of a sum's parts does not decide; bounds leave SLACK (and a share of the score) for it.
PLACES, SLACK, SLACK_SHARE = 9, 1e-7, 1e-11
FIRST_POSTINGS = 2048
#: Texts are read, shards cut and terms counted in batches of so many rows: what goes to Python and back is held several times over.
BUILDING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
#: Share by which sums in single precision may be off.
ROUNDED = 5e-5
#: A shard's most frequent terms (in one of DENSE_SHARE documents at least) are kept by document too.
DENSE_TERMS, DENSE_SHARE = 1024, 12
TEXT_ROWS = 500
#: Block maxima that a shard holds for a block of queries; ranges are wider where there would be more.
BOUND_CELLS = 1 << 22
#: Queries that a shard works on together.
GROUP = 128
#: Blocks and documents of their ranges that are worked on at once.
BLOCK_CELLS = 1 << 17
#: Postings from which on a list is copied as a slice.
SLICE = 32
POSTING = np.dtype([("doc", np.int32), ("weight", np.float32)])
#: Shards that a task searches one after another: what it found in some prunes the others. Fewer where cores would idle.
TASK_SHARDS = 48
STEP, COUNTED_TERMS = 1 << 17, 1 << 19

#: ASCII but digits and letters separates terms; A-Z is lower-cased.
_AS_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct terms of a whole text as sorted 64-bit hashes, their counts, and the number of terms."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_AS_SPACE).split()
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    terms, counts = np.unique(codes, return_counts=True)
    return terms, counts.astype(np.int32), len(words)


def analysed(docs: DataFrame) -> DataFrame:
    """(doc_id, length, terms, counts), in small batches: a long document's terms take room too."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXT_ROWS):
                part = b.slice(lo, TEXT_ROWS)
                got = [terms_of(t) for t in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(g[0]) for g in got)], dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g[i] for g in got]))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[2] for g in got], pa.int64()), *lists], names=["doc_id", "length", "terms", "counts"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(made, "doc_id bigint, length bigint, terms array<bigint>, counts array<int>")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df), added up per task before they are shuffled."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(np.unique(b["terms"].flatten().to_numpy(), return_counts=True))
            size += len(held[-1][0])
            if size > COUNTED_TERMS:
                held = [added(held)]
                size = len(held[0][0])
                if 2 * size > COUNTED_TERMS:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["term", "n"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, added(held))), names=["term", "n"])

    return rows.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    n = ends - starts
    return np.repeat(ends - n.cumsum(), n) + np.arange(n.sum())


class Shard:
    """The index of some documents, by length: what is stored is ids, lengths, terms, and lists of documents and counts; the rest is derived when it is loaded."""

    STORED = ("ids", "lengths", "vocab", "lists", "post_doc", "post_count", "mean_length")

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, mean_length: float):
        """terms and counts hold the documents' entries one after another, n the number of each."""
        by_length = np.argsort(lengths, kind="stable")  # documents of like lengths have like impacts, so a range's maxima are close
        ends = n.cumsum()
        at = spans((ends - n)[by_length], ends[by_length])
        self.ids, self.lengths, n, self.mean_length = doc_ids[by_length], lengths[by_length], n[by_length], mean_length
        terms, counts = terms[at], counts[at]
        order = np.argsort(terms, kind="stable")  # by term, then document
        held, terms, at = terms[order], None, None
        first = np.flatnonzero(np.diff(held, prepend=~held[:1]) != 0)
        self.vocab, self.lists = held[first], np.append(first, len(held)).astype(np.int32)
        del held
        self.post_doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
        self.post_count = counts[order].astype(np.min_scalar_type(counts.max()))

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.STORED}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.wake()

    def wake(self) -> Shard:
        """Derive the documents' own lists, and the impacts of the most frequent terms by document."""
        df = np.diff(self.lists)
        self.norm = K1 * (1 - B + B * self.lengths / self.mean_length)
        order = np.argsort(self.post_doc, kind="stable")  # by document, then term
        self.term, self.count = np.repeat(np.arange(len(df), dtype=np.int32), df)[order], self.post_count[order]
        del order
        self.ends = np.bincount(self.post_doc, minlength=len(self.ids)).cumsum()
        common = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        common = common[df[common] * DENSE_SHARE >= len(self.ids)]
        self.column = np.full(len(self.vocab), -1, np.int16)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(self.ids), len(common)), np.float32)
        for i, t in enumerate(common.tolist()):
            at = slice(self.lists[t], self.lists[t + 1])
            self.dense[self.post_doc[at], i] = self.impacts(at)
        self.weight = np.zeros(len(self.vocab))
        self.held = self.touched = 0  # postings of the queries' lists, and those that were read
        return self

    def impacts(self, at: np.ndarray | slice) -> np.ndarray:
        f = self.post_count[at].astype(np.float32)
        return f * np.float32(K1 + 1) / (f + self.norm[self.post_doc[at]].astype(np.float32))

    def score(self, docs: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Full scores of docs for terms (ascending places in vocab): a document's terms are added up in the order of their hashes, whatever the shard."""
        n = self.ends[docs] - np.append(0, self.ends)[docs]
        held, of = spans(self.ends[docs] - n, self.ends[docs]), np.repeat(np.arange(len(docs)), n)
        self.touched += len(held)
        self.weight[terms] = idf
        weight = self.weight[self.term[held]]
        self.weight[terms] = 0
        hit = weight > 0
        of, count = of[hit], self.count[held[hit]].astype(np.float64)
        return np.round(np.bincount(of, count * (K1 + 1) / (count + self.norm[docs][of]) * weight[hit], len(docs)), PLACES)

    def prepare(self, terms: np.ndarray, idf: np.ndarray) -> None:
        """For queries of these terms: their lists, weighted by idf, and the block maxima of the lists, by term and range of documents."""
        at = np.minimum(np.searchsorted(self.vocab, terms), len(self.vocab) - 1)
        here = self.vocab[at] == terms
        self.place, self.idf = np.where(here, at, -1).astype(np.int32), idf
        self.dense_at = np.where(here, self.column[at], np.int16(-1))
        rare = np.flatnonzero(here & (self.dense_at < 0))
        self.row = np.full(len(terms), -1, np.int32)
        self.row[rare] = np.arange(len(rare))
        starts, ends = self.lists[at[rare]], self.lists[at[rare] + 1]
        n = ends - starts
        self.width = BLOCK_DOCS
        while self.width < len(self.ids) and len(rare) * -(-len(self.ids) // self.width) > BOUND_CELLS:
            self.width *= 2
        self.n_ranges = -(-len(self.ids) // self.width)
        self.postings = np.empty(int(n.sum()), POSTING)  # of rare terms: document and weight side by side, so that a list is one slice
        self.blocks = np.zeros((len(rare), self.n_ranges + 1), np.int32)  # where in postings a range's block begins
        tops = np.zeros(len(rare) * self.n_ranges, np.float32)
        bounds = np.append(0, n.cumsum())
        lo = 0
        while lo < len(rare):  # a task's memory is what bounds a shard
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP, side="right")) - 1)
            at_part, part = spans(starts[lo:hi], ends[lo:hi]), slice(bounds[lo], bounds[hi])
            weight = self.impacts(at_part) * np.repeat(idf[rare[lo:hi]].astype(np.float32), n[lo:hi])
            self.postings["doc"][part], self.postings["weight"][part] = self.post_doc[at_part], weight
            cell = np.repeat(np.arange(lo, hi) * self.n_ranges, n[lo:hi]) + self.post_doc[at_part] // self.width
            first = np.flatnonzero(np.diff(cell, prepend=-1) != 0)
            tops[cell[first]] = np.maximum.reduceat(weight, first)
            self.blocks[cell[first] // self.n_ranges, cell[first] % self.n_ranges + 1] = np.diff(first, append=len(cell))
            lo = hi
        self.tops = tops.reshape(-1, self.n_ranges)
        self.starts = bounds
        self.blocks[:, 0] = bounds[:-1]
        np.cumsum(self.blocks, axis=1, out=self.blocks)
        self.top = self.tops.max(axis=1, initial=0)
        self.dense_top = np.maximum.reduceat(self.dense, np.arange(0, len(self.ids), self.width), axis=0).T
        self.packed = self.postings.view(np.int64)

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of a query (ids, scores), best first, ties by id; those below the score least may be missing."""
        self.prepare(terms, idf)
        found = [x[1:] for x in self.search_all(np.arange(len(terms)), np.array([len(terms)]), np.array([least]), k)]
        return found[0] if found else (self.ids[:0], np.zeros(0))

    def search_all(self, members: np.ndarray, ends: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For queries of prepared terms (members: places of each query's terms, ascending, up to its end), those that find something: number, ids and scores as of search."""
        for lo in range(0, len(ends), GROUP):
            yield from self._search_group(members, np.append(ends[lo - 1] if lo else 0, ends[lo : lo + GROUP]), least[lo : lo + GROUP].copy(), k, lo)

    def _search_group(self, members: np.ndarray, ends: np.ndarray, least: np.ndarray, k: int, number: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        mine = members[ends[0] : ends[-1]]
        of = np.repeat(np.arange(len(least)), np.diff(ends))
        # the most frequent terms come last: their impacts are kept by document
        column = self.dense_at[mine]
        dense = column >= 0
        last = np.zeros((len(least), self.dense.shape[1]), np.float32)
        last[of[dense], column[dense]] = self.idf[mine[dense]]
        row = self.row[mine]
        rare = row >= 0
        rows, n_rows = row[rare], np.bincount(of[rare], minlength=len(least))
        of_rows = n_rows.cumsum()
        lists = [rows[hi - n : hi] for n, hi in zip(n_rows.tolist(), of_rows.tolist())]
        share = ROUNDED + 2.0**-22 * np.diff(ends)  # sums of block maxima are in single precision too
        for i in np.flatnonzero(least <= 0).tolist():
            least[i] = self._first_least(lists[i], last[i], k)
        last_top = last @ self.dense_top
        bound, some = last_top.copy(), n_rows > 0
        if some.any():
            bound[some] += np.add.reduceat(self.tops[rows], (of_rows - n_rows)[some], axis=0)
        # ranges whose block maxima do not reach the k-th best score have no pivot
        alive = (bound * (1 + share[:, None]) + SLACK >= least[:, None]) & (bound > 0)
        n_alive = alive.sum(axis=1)
        whole = np.flatnonzero(2 * n_alive > self.n_ranges)
        common = last[whole] @ self.dense.T if len(whole) else []  # one product for all queries of which nearly all is to be read
        n_postings = np.bincount(of[self.place[mine] >= 0], np.diff(self.lists)[self.place[mine][self.place[mine] >= 0]], len(least))
        self.held += int(n_postings.sum())
        found = self._up_to_pivots(lists, last, last_top, alive & (2 * n_alive <= self.n_ranges)[:, None], least, share)
        for i, sums in zip(whole.tolist(), self._all_up([lists[i] for i in whole.tolist()], common)):
            docs = np.flatnonzero(sums >= (max(least[i], SLACK) - SLACK) / (1 + ROUNDED))
            docs = docs[sums[docs] > 0]
            found[i] = docs, sums[docs]
        self.touched += int(n_postings[whole].sum())
        for i, (docs, sums) in found.items():
            if len(docs) > k:
                docs = docs[sums * (1 + ROUNDED) + SLACK >= np.partition(sums, -k)[-k] * (1 - ROUNDED) - SLACK]
            if len(docs):
                terms = mine[ends[i] - ends[0] : ends[i + 1] - ends[0]]
                terms = terms[self.place[terms] >= 0]
                scores = self.score(docs, self.place[terms], self.idf[terms])
                order = np.lexsort((self.ids[docs], -scores))[:k]
                order = order[scores[order] > 0]
                yield number + i, self.ids[docs[order]], scores[order]

    def _all_up(self, lists: list[np.ndarray], common: np.ndarray) -> Iterator[np.ndarray]:
        """By query, every document's sum: whole lists on top of what the most frequent terms give."""
        if not lists:
            return
        rows, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        starts, ends = self.starts[rows], self.starts[rows + 1]
        long, n = ends - starts >= SLICE, np.arange(len(lists) + 1)
        short = self.packed[spans(starts[~long], ends[~long])]
        to_short = np.append(0, np.bincount(of[~long], (ends - starts)[~long], len(lists)).cumsum().astype(np.int64)).tolist()
        to_long, starts, ends = np.searchsorted(of[long], n).tolist(), starts[long].tolist(), ends[long].tolist()
        for i, sums in enumerate(common):
            part = slice(to_long[i], to_long[i + 1])
            read = [self.packed[a:b] for a, b in zip(starts[part], ends[part])]
            read.append(short[to_short[i] : to_short[i + 1]])
            read = np.concatenate(read).view(POSTING)
            yield np.bincount(read["doc"], read["weight"], len(self.ids)) + sums

    def _first_least(self, rows: np.ndarray, last: np.ndarray, k: int) -> float:
        """A first k-th best score, from documents that hold the terms of the largest bounds."""
        rows = rows[np.argsort(-self.top[rows], kind="stable")]
        if not len(rows):
            return 0.0
        n = self.starts[rows + 1] - self.starts[rows]
        rows = rows[: max(1, int(np.searchsorted(n.cumsum(), FIRST_POSTINGS)))]
        self.touched += int(n[: len(rows)].sum())
        read = self.packed[spans(self.starts[rows], self.starts[rows + 1])].view(POSTING)
        sums = np.bincount(read["doc"], read["weight"], len(self.ids))
        tried = np.argpartition(-sums, min(2 * k, len(sums) - 1))[: 2 * k]
        self.touched += len(tried) * int(np.count_nonzero(last))
        sums = sums[tried] + self.dense[tried] @ last
        return max(0.0, np.partition(sums, -k)[-k] * (1 - ROUNDED) - SLACK) if len(sums) >= k else 0.0

    def _up_to_pivots(self, lists: list[np.ndarray], last: np.ndarray, last_top: np.ndarray, alive: np.ndarray, least: np.ndarray, share: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By query, the documents of its ranges that may have the score least, and their sums."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        queries = np.flatnonzero(alive.any(axis=1))
        size = (alive[queries].sum(axis=1) * np.array([len(lists[i]) + self.width for i in queries.tolist()], np.int64)).cumsum()
        for part in np.split(queries, np.flatnonzero(np.diff(size // BLOCK_CELLS)) + 1):
            if not len(part):
                continue
            # a slot is a range of a query; its blocks stand from the largest bound of a term down
            rows = [lists[i][np.argsort(-self.top[lists[i]], kind="stable")] for i in part.tolist()]
            ends = np.cumsum([len(r) for r in rows])
            rows, starts = np.concatenate(rows), np.append(0, ends[:-1])
            query, ranges = np.nonzero(alive[part])
            slot, row = np.repeat(np.arange(len(query)), (ends - starts)[query]), rows[spans(starts[query], ends[query])]
            top = self.tops[row, ranges[slot]]
            slot, row, top = slot[top > 0], row[top > 0], top[top > 0].astype(np.float64)
            query = part[query]
            of_slot = np.bincount(slot, top, len(query))
            reach = of_slot.cumsum()[slot] - top.cumsum() + top + last_top[query, ranges][slot]
            goal, more = np.maximum(least[query], SLACK), 1 + share[query]
            sums, left = np.zeros(len(query) * self.width), np.ones(len(slot), bool)
            # blocks up to the pivots, then those behind them for ranges in which documents are left
            read = reach * more[slot] + SLACK >= goal[slot]
            for _ in (0, 1):
                begin, end = self.blocks[row[read], ranges[slot[read]]], self.blocks[row[read], ranges[slot[read]] + 1]
                posting = self.packed[spans(begin, end)].view(POSTING)
                self.touched += len(posting)
                sums += np.bincount(np.repeat((slot[read] - ranges[slot[read]]) * self.width, end - begin) + posting["doc"], posting["weight"], len(sums))
                left &= ~read
                rest = np.bincount(slot[left], top[left], len(query)) + last_top[query, ranges]
                keep = (sums.reshape(-1, self.width) + rest[:, None]) * more[:, None] + SLACK >= goal[:, None]
                read = left & keep.any(axis=1)[slot]
                if not read.any():
                    break
            slot, at = np.nonzero(keep)
            docs, query = ranges[slot] * self.width + at, query[slot]
            real = docs < len(self.ids)
            slot, at, docs, query = slot[real], at[real], docs[real], query[real]
            total = sums[slot * self.width + at]
            for lo in range(0, len(docs), GROUP):
                some = slice(lo, lo + GROUP)
                total[some] += np.einsum("ij,ij->i", self.dense[docs[some]], last[query[some]])
            self.touched += int(np.count_nonzero(last, axis=1)[query].sum())
            keep = total * (1 + ROUNDED) + SLACK >= np.maximum(least[query], SLACK)
            docs, query, total = docs[keep], query[keep], total[keep]
            first = np.flatnonzero(np.diff(query, prepend=-1) != 0)
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(query)]):
                found[int(query[lo])] = docs[lo:hi], total[lo:hi]
        return found


class Kinds:
    """Kinds of documents that share words, such as languages, learned from a few: shards of one kind have block maxima that rule the queries of others out."""

    def __init__(self, n: np.ndarray, terms: np.ndarray):
        found, df = np.unique(terms, return_counts=True)
        some = np.argsort(-df, kind="stable")[:KIND_TERMS]
        self.terms, order = found[np.sort(some)], np.sort(some)
        self.weight = np.log(1 + len(n) / df[order]).astype(np.float32)
        x = self._matrix(n, terms)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        self.centres = x[np.random.default_rng(0).permutation(len(x))[:KINDS]].T
        for _ in range(KIND_TURNS):
            kind = (x @ self.centres).argmax(axis=1)
            made = np.stack([x[kind == i].sum(axis=0) if (kind == i).any() else self.centres[:, i] for i in range(self.centres.shape[1])], axis=1)
            self.centres = made / np.maximum(np.linalg.norm(made, axis=0), 1e-9)

    def _matrix(self, n: np.ndarray, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        x = np.zeros((len(n), len(self.terms)), np.float32)
        x[np.repeat(np.arange(len(n)), n)[hit], at[hit]] = self.weight[at[hit]]
        return x

    def of(self, n: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return (self._matrix(n, terms) @ self.centres).argmax(axis=1)


def build_shards(rows: DataFrame, mean_length: float) -> DataFrame:
    """(index binary): the shards of rows (doc_id, length, terms, counts), cut from each task's rows, kind by kind."""

    def shard_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(parts).combine_chunks()
        terms, counts = b["terms"].chunk(0), b["counts"].chunk(0)
        made = Shard(b["doc_id"].to_numpy(), b["length"].to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), counts.flatten().to_numpy(), mean_length)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], names=["index"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held, n_rows, n_postings = None, [[] for _ in range(KINDS)], [0] * KINDS, [0] * KINDS
        for whole in filter(len, batches):
            lists = whole["terms"]
            n, terms = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            kinds = kinds or Kinds(n, terms)
            kind = kinds.of(n, terms)
            for i in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == i)
                part, sizes, at = whole.take(pa.array(mine)).select(["doc_id", "length", "terms", "counts"]), n[mine], 0
                while at < len(mine):
                    fits = int(np.searchsorted(n_postings[i] + sizes[at:].cumsum(), SHARD_POSTINGS, side="right"))
                    take = min(len(mine) - at, SHARD_DOCS - n_rows[i], max(fits, 0 if n_rows[i] else 1))
                    if take == 0:
                        yield shard_of(held[i])
                        held[i], n_rows[i], n_postings[i] = [], 0, 0
                        continue
                    held[i].append(part.slice(at, take))
                    n_rows[i], n_postings[i], at = n_rows[i] + take, n_postings[i] + int(sizes[at : at + take].sum()), at + take
            while sum(n_postings) > HELD_SHARDS * SHARD_POSTINGS:
                i = int(np.argmax(n_postings))
                yield shard_of(held[i])
                held[i], n_rows[i], n_postings[i] = [], 0, 0
        for parts in held:
            if parts:
                yield shard_of(parts)

    return rows.filter("length > 0").mapInArrow(build, "index binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """(block binary): queries (query_id, terms, idf) packed, so many that a block stays small: ids, ends, places of terms, terms, their idf."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_terms = [], 0

        def packed() -> pa.RecordBatch:
            terms, first, members = np.unique(np.concatenate([t for _, t, _ in held]), return_index=True, return_inverse=True)
            idf = np.concatenate([w for _, _, w in held])[first]
            block = np.array([q for q, _, _ in held]), np.cumsum([len(t) for _, t, _ in held]), members.astype(np.int32), terms, idf
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

        for b in batches:
            for q, terms, idf in zip(b["query_id"].to_pylist(), b["terms"], b["idf"]):
                held.append((q, terms.values.to_numpy(), idf.values.to_numpy()))
                n_terms += len(held[-1][1])
                if n_terms >= BLOCK_TERMS:
                    yield packed()
                    held, n_terms = [], 0
        if held:
            yield packed()

    return queries.select("query_id", "terms", "idf").mapInArrow(pack, "block binary")


def search_shards(shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): for every query the top k of the shards that a task meets. A task's queries are those of a partition of blocks at most."""

    def begun() -> tuple:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def search(shard: Shard, block: tuple[np.ndarray, ...]) -> None:
            queries, ends, members, terms, idf = block
            shard.prepare(terms, idf)
            least = np.array([found[1][-1] * (1 - SLACK_SHARE) - SLACK if (found := best.get(q)) and len(found[0]) == k else 0.0 for q in queries.tolist()])
            for i, more, their in shard.search_all(members, ends, least, k):
                q = int(queries[i])
                ids, scores = best.get(q, (shard.ids[:0], np.zeros(0)))
                if len(more):
                    ids, scores = np.concatenate([ids, more]), np.concatenate([scores, their])
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = ids[order], scores[order]

        def finish() -> pa.RecordBatch | None:
            if best:
                of = np.repeat(np.array(list(best), np.int64), [len(ids) for ids, _ in best.values()])
                return pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(np.concatenate([x[i] for x in best.values()])) for i in (0, 1))], names=["query_id", "doc_id", "score"])

        return search, finish

    n_shards, cores = shards.count(), shards.sparkSession.sparkContext.defaultParallelism
    shards = shards.coalesce(max(1, n_shards // TASK_SHARDS, min(n_shards, cores)))
    return meet(shards, blocks, begun, "query_id bigint, doc_id bigint, score double")


def top_k(docs: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): for every row of docs with is_query, its text as the query, the k best rows of docs.

    A query's weight of a term is its idf, however often the query holds it;
    idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Scores are rounded to 9
    places, ties go to the smaller doc_id. The query's own row takes part.
    Rows without a common term are not returned, so a null or empty text finds
    nothing and is never found. Rows with a null doc_id take no part. Rows with
    the same doc_id are documents each, but one query: the terms of all of
    them. Other columns are not read; an empty table gives no rows.
    """
    rows = stash(analysed(docs.select("doc_id", "text")), "analysed", BUILDING)
    n_terms = F.size("terms")
    n_docs, mean_length, n_postings, n_asked = rows.agg(F.count("*"), F.avg("length"), F.sum(n_terms), F.coalesce(F.sum(F.when(is_query, n_terms)), F.lit(0))).first()
    if not mean_length:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    n_tasks = max(rows.sparkSession.sparkContext.defaultParallelism, n_postings // (TASK_BUILDS * SHARD_POSTINGS))
    shards = stash(build_shards(rows.coalesce(n_tasks), mean_length).withColumn("no", F.monotonically_increasing_id()), "shards", BUILDING, LARGE)
    asked = rows.filter(is_query).select(F.col("doc_id").alias("query_id"), F.explode("terms").alias("term"))
    terms = join_heavy(asked, stash(document_frequencies(rows), "term-counts", BUILDING), ["term"], "df", n_postings)
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    queries = terms.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("term", idf.alias("idf")))).alias("t"))
    queries = queries.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")).coalesce(-(-n_asked // BLOCK_TERMS) or 1)
    blocks = stash(query_blocks(queries), "query-blocks", options=LARGE)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = search_shards(shards, blocks, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return stash(best.select("query_id", "rank", "doc_id", "score"), "best", settings=MEETING)


def query(docs: DataFrame) -> DataFrame:
    return top_k(docs.select("doc_id", "text"), F.col("doc_id") % 100 == 0)


#: op1 for DuckDB: all scores of all pairs that share a term.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM w
), t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w
), p AS (SELECT doc_id, term, any_value(dl) AS dl, count(*)::DOUBLE AS tf FROM t GROUP BY doc_id, term
), f AS (SELECT term, ln(1 + ((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term
), r AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(f.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / (SELECT mean FROM s)))), 9) AS score
  FROM p AS q JOIN f USING (term) JOIN p ON p.term = q.term WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM r)
SELECT query_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
