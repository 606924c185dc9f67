"""The registered queries against SQL, brute force, an independent tokenizer, or held-out labels."""

import itertools
import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, differences
from thriftline.llm import bm25, histogram_sort, jaccard_join, lang_id, line_dedup, pfair, queries, sentencepiece_fst, vp_tree
from thriftline.llm.common import table
from thriftline.llm.cuckoo import CuckooFilter
from thriftline.llm.graph import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF) == []


def test_pieces_are_those_of_an_independent_tokenizer(spark):
    import sentencepiece

    model = sentencepiece_fst.default_model()
    other = sentencepiece.SentencePieceProcessor(model_file=model)
    machine = sentencepiece_fst.load(model)
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect()]
    texts += ["", " ", "  a  ", "Hello  world\n ▁x　é\t🤗", "    def f(x):\n\n        return  x", "a" * 500, "日本語 한국어", "<s> </s>", "==--//", "\x00\x01", *[" " * i + "ab" + " " * i for i in range(40)]]
    for t in texts:
        assert machine.encode(t).tolist() == other.encode(t), t[:80]
        assert machine.decode(machine.encode(t)) == t.replace("▁", " ")


def test_unigram_path_is_the_best_of_all_segmentations():
    scores = {"a": -1.0, "b": -1.5, "ab": -2.2, "aba": -3.0, "ba": -2.0, "▁": -0.5, "▁a": -1.2}
    pieces = [("<unk>", 0.0, sentencepiece_fst.UNKNOWN), *[(p, s, sentencepiece_fst.NORMAL) for p, s in scores.items()]]
    m = sentencepiece_fst.Machine(pieces, sentencepiece_fst.UNIGRAM, sentencepiece_fst.Normaliser(True, False, True, b""))
    for text in ("abab", "aab", "baba ab", "abaabab"):
        raw = "▁" + text.replace(" ", "▁")
        best = None
        for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(raw)]
            parts = [raw[i:j] for i, j in zip(at, at[1:])]
            if all(p in scores for p in parts):
                best = max(best or -1e9, sum(scores[p] for p in parts))
        assert sum(m.score[i] for i in m.encode(text)) == pytest.approx(best)


@pytest.fixture(scope="module")
def neighbours(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    best = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -s))[:20]]
    return best


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (vp_tree.FACTOR, 0.9)])
def test_neighbours_recall(spark, neighbours, factor, least):
    got = {}
    for r in vp_tree.nearest(table(spark, SF, "embeddings"), F.col("vec_id") % 20 == 0, factor=factor).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {len(v) for v in got.values()} == {20}
    assert sum(len(set(got[q]) & set(v)) for q, v in neighbours.items()) >= least * 20 * len(neighbours)
    assert factor < 1 or got == neighbours


def test_shards_are_even_and_keep_copies_together(spark):
    rows = queries.op4_histogram_sort_sharding(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    ideal, largest = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert len(rows) == len(docs) and set(sizes) == set(range(8)) and max(abs(s - ideal) for s in sizes.values()) <= 0.002 * ideal + largest
    of = {}
    for r in rows:
        of.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_a_group_of_a_third_of_all_rows_is_spread(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x" * 50)).otherwise(F.concat(F.lit("y" * 40), F.col("id"))).alias("text"))
    from thriftline.llm.histogram_sort import shard_by_bytes

    sizes = [r["s"] for r in shard_by_bytes(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 120


def test_mix_deviates_by_less_than_a_block(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    weights = {"a": 5, "b": 3, "c": 1, "*": 1}
    total = 9
    rows = [r for r in pfair.mix(docs, weights, 10).select("mix_pool", "mix_block", "mix_slot", "mix_on_target").distinct().orderBy("mix_slot").collect()]
    done, n = Counter(), 0
    for r in rows:
        if not r.mix_on_target:
            break
        assert r.mix_slot == n
        done[r.mix_pool] += 1
        n += 1
        assert all(abs(done[p] - n * w / total) < 1 for p, w in weights.items() if p != "*")
    assert n > 100 and len(rows) == 240 + 120 + 40


def test_line_state_is_reversible(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    a, b = docs.filter("doc_id % 4 <> 1"), docs.filter("doc_id % 4 = 1")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole, part = line_dedup.build(docs), line_dedup.build(a)
    grown = line_dedup.insert(part, b)
    assert key(grown.repeated) == key(whole.repeated)
    shrunk = line_dedup.delete(grown, b)
    assert key(shrunk.repeated) == key(part.repeated) and key(shrunk.refs) == key(part.refs)
    long = line_dedup.long_lines(a)
    assert key(line_dedup.apply(a, shrunk, long)) == key(line_dedup.apply(a, part, long))
    long = line_dedup.long_lines(docs)
    assert key(line_dedup.apply(docs, grown, long)) == key(line_dedup.dedup_lines(docs))


def test_cuckoo_filter_holds_and_lets_go():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    f = CuckooFilter.sized(5000)
    f.insert(h1, h2)
    f.insert(h1[:1].repeat(20), h2[:1].repeat(20))  # more copies than two buckets hold
    assert f.contains(h1, h2).all()
    f.delete(h1[:2500], h2[:2500])
    assert f.contains(h1[2500:], h2[2500:]).all() and f.contains(h1[1:2500], h2[1:2500]).mean() < 0.01 and f.contains(h1[:1], h2[:1]).all()


def test_components_follow_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90)}


@pytest.mark.parametrize("measure", [jaccard_join.Measure(), jaccard_join.NEAR_COPIES])
def test_similar_groups_are_those_of_all_pairs(spark, measure):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    sets = {r.doc_id: set(jaccard_join.shingles(r.text, measure.n)[0].tolist()) for r in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if measure.den * len(sets[a] & sets[b]) >= measure.num * len(sets[a] | sets[b]) and sets[a] and sets[b]:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_groups(table(spark, SF, "documents"), measure).collect()}
    assert got == {d: root(d) for d in sets}


def test_language_of_held_out_documents(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def shard_of(texts):
    parts = [bm25.terms_of(t) for t in texts]
    made = bm25.Shard(np.arange(len(texts)) * 3, np.array([p[2] for p in parts]), np.array([len(p[0]) for p in parts]), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.mean([p[2] for p in parts]))
    df = Counter(t for p in parts for t in p[0].tolist())
    idf_of = lambda t: np.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5))
    return made.wake(), [(p[0], np.array([idf_of(t) for t in p[0].tolist()])) for p in parts]


def brute_force(shard, terms, idf):
    at = np.minimum(np.searchsorted(shard.vocab, terms), len(shard.vocab) - 1)
    here = shard.vocab[at] == terms
    every = shard.score(np.arange(len(shard.ids)), at[here], idf[here])
    best = [i for i in np.lexsort((shard.ids, -every))[:10] if every[i] > 0]
    return shard.ids[best].tolist(), every[best].tolist()


@pytest.mark.parametrize("stored", [False, True])
def test_bm25_prunes_without_loss(spark, stored):
    docs = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    shard, queries = shard_of([t for t in docs if bm25.terms_of(t)[2]])
    if stored:
        shard = pickle.loads(pickle.dumps(shard, 5))
    for terms, idf in queries[::7]:
        ids, scores = shard.search(terms, idf, 10)
        assert (ids.tolist(), scores.tolist()) == brute_force(shard, terms, idf)
        ids, scores = shard.search(terms, idf, 10, scores[-1] - 1e-6)  # with what another shard found
        assert (ids.tolist(), scores.tolist()) == brute_force(shard, terms, idf)


def test_bm25_skips_blocks_of_postings(monkeypatch):
    """Short queries of a rare and some frequent words over many documents: most postings are never touched."""
    monkeypatch.setattr(bm25, "FIRST_POSTINGS", 100)
    rng = np.random.default_rng(3)
    texts = [" ".join([f"common{w}" for w in rng.integers(0, 400, 60)] + [f"rare{i // 40}"] * (1 + i % 5)) for i in range(6000)]
    shard, _ = shard_of(texts)
    df = lambda w: sum(w in t.split() for t in texts)
    for i in range(0, 6000, 500):
        words = [f"rare{i // 40}", *[f"common{w}" for w in (i // 500, 17, 99)]]
        idf = {bm25.terms_of(w)[0][0]: np.log1p((6000 - df(w) + 0.5) / (df(w) + 0.5)) for w in words}
        terms = np.array(sorted(idf))
        found = shard.search(terms, np.array([idf[t] for t in terms]), 10)
        assert (found[0].tolist(), found[1].tolist()) == brute_force(shard, terms, np.array([idf[t] for t in terms]))
    shard.held = shard.touched = 0
    for i in range(0, 6000, 500):
        terms = np.array(sorted(bm25.terms_of(w)[0][0] for w in (f"rare{i // 40}", "common1", "common17", "common99")))
        shard.search(terms, np.where(terms == bm25.terms_of(f"rare{i // 40}")[0][0], 5.0, 1.0), 10)
    assert 0 < shard.touched < 0.5 * shard.held


def test_bm25_builds_its_index_once(spark, monkeypatch):
    """Many shards and many blocks of queries: every shard is built once, whatever the number of blocks."""
    monkeypatch.setattr(bm25, "SHARD_POSTINGS", 3000)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 500)
    built, real = [], bm25.build_shards
    monkeypatch.setattr(bm25, "build_shards", lambda *a: built.append(real(*a)) or built[-1])
    docs = table(spark, SF, "documents").select("doc_id", "text")
    few = bm25.top_k(docs, F.col("doc_id") % 5 == 0).collect()
    assert len(built) == 1 and built[0].count() > 5
    monkeypatch.undo()
    assert sorted(few) == sorted(bm25.top_k(docs, F.col("doc_id") % 5 == 0).collect())


def test_pipeline(spark):
    """Each stage by plain Python on what the stage before it kept."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    seen = docs.cache()
    made = stages["language ID"](spark, seen, SF)
    assert sorted(r.doc_id for r in made.collect()) == sorted(r.doc_id for r in seen.collect() if any(c.isalpha() for c in r.text or ""))
    seen = made.cache()
    made = stages["line dedup"](spark, seen, SF).cache()
    texts = {r.doc_id: r.text for r in seen.collect()}
    keyed = {d: [(line, line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for line in t.split("\n")] for d, t in texts.items()}
    holders = {}
    for d, rows in keyed.items():
        for _, k in rows:
            holders.setdefault(k, set()).add(d)
    want = {d: "\n".join(line for line, k in rows if len(k) < 40 or len(holders[k]) < 5 or max(holders[k]) == d) for d, rows in keyed.items()}
    assert {r.doc_id: r.text for r in made.collect()} == want
    made = spark.createDataFrame(made.collect(), made.schema)  # the next stage drops what this one reads
    groups = {r.doc_id: r.component_id for r in jaccard_join.similarity_groups(made, jaccard_join.NEAR_COPIES).collect()}
    kept = stages["n-gram Jaccard join"](spark, made, SF)
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    assert {r.doc_id for r in kept.collect()} == set(groups.values())
    mixed = stages["mixing sources"](spark, kept, SF)
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, kept.collect()))
    last = stages["SentencePiece"](spark, kept, SF)
    machine = sentencepiece_fst.load(sentencepiece_fst.default_model())
    for r in last.limit(30).collect():
        assert r.piece_ids == machine.encode(want[r.doc_id]).tolist() and r.text == want[r.doc_id]


def test_query_names():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


@pytest.mark.parametrize("measure", [jaccard_join.Measure(), jaccard_join.NEAR_COPIES])
def test_a_large_group_of_near_copies_loses_no_link(spark, measure):
    """Long index lists of frequent shingles, borderline similarities, and texts of very different lengths."""
    rng = np.random.default_rng(5)
    texts = []
    for length, copies, most in ((300, 500, 12), (2500, 40, 120), (60, 100, 3)):
        base = [f"w{rng.integers(10**6)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, length, rng.integers(0, most)):
                words[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(words))
    sets = [set(jaccard_join.shingles(t, measure.n)[0].tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if group[i] != group[j] and measure.den * len(sets[i] & sets[j]) >= measure.num * len(sets[i] | sets[j]):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_groups(docs, measure).collect()}
    assert [got[i] for i in range(len(texts))] == group and len(set(group)) > 3


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("part", [8, 4096])
def test_groups_when_lists_are_dealt_and_ids_repeat(spark, monkeypatch, limit, part):
    """A shingle in every text, one id with different texts, repeated rows; both ways of fetching texts, long and short parts."""
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_IDS", limit)
    monkeypatch.setattr(jaccard_join, "LIST_PART", part)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    rng = np.random.default_rng(11)
    bases = [[f"w{rng.integers(10**6)}" for _ in range(rng.integers(30, 60))] for _ in range(25)]
    rows = []
    for i in range(300):
        words = list(bases[i % 25])
        for at in rng.integers(0, len(words), rng.integers(0, 3)):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i if i % 10 else i // 20, "one phrase for all " + " ".join(words)))
    rows += rows[:20] + [(1000, None), (1000, "only this"), (1001, "only this"), (None, "only this")]
    measure = jaccard_join.Measure()
    sets = [set(jaccard_join.shingles(t, 3)[0].tolist()) for _, t in rows]
    group = {d: d for d, _ in rows if d is not None}

    def merge(x, y):
        for d in group:
            if group[d] == max(x, y):
                group[d] = min(x, y)

    for (a, x), (b, y) in itertools.combinations(zip([d for d, _ in rows], sets), 2):
        if None not in (a, b) and x and y and group[a] != group[b] and measure.den * len(x & y) >= measure.num * len(x | y):
            merge(group[a], group[b])
    got = jaccard_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), measure).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(d), len(s), str(group.get(d))) for (d, _), s in zip(rows, sets))
    assert 5 < len(set(group.values())) < 200


def test_two_texts_of_one_id_link_its_neighbours(spark):
    a, b, z = ("alpha beta gamma delta " * 3).split(), [f"b{i}" for i in range(40)], ["z"]
    rows = [(1, " ".join(a + b[:30])), (1, " ".join(b[30:] + a[::-1])), (2, " ".join(a + b[:30] + z)), (3, " ".join(b[30:] + a[::-1] + z)), (4, "something else here")]
    measure = jaccard_join.Measure(3, 80, 100)
    got = jaccard_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), measure).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def plain_dedup(rows, min_docs=5, min_chars=40):
    """(doc_id, n_lines, n_dropped, kept) of each row (doc_id, text) by plain Python."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_where_one_id_has_different_texts(spark):
    line = "this very line is longer than forty characters, truly"
    rows = [(i, f"{line}\nown {i}") for i in range(6)] + [(3, "a short line\nnobody repeats"), (3, f"x\n{line.upper()}"), (5, "first\nsecond"), (None, line), (2, None), (4, f"own 4\n{line}")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    as_text = lambda rows: sorted(map(str, rows))
    assert as_text((r.doc_id, r.n_lines, r.n_dropped, r["kept"]) for r in got) == as_text(plain_dedup(rows))


def test_line_filters_grow_with_their_keys(spark, monkeypatch):
    """Ten times the keys: the filters are built anew before they are too full, and the state is that of a fresh build."""
    long = lambda i: f"line number {i} of those that are repeated, long enough to count"
    docs = spark.range(40).select("id").collect()
    rows = [(d.id, "\n".join(long(i) for i in range(50))) for d in docs[:6]] + [(100 + d.id, "\n".join(long(i) for i in range(50, 550))) for d in docs[:6]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = line_dedup.build(df.filter("doc_id < 100"))
    grown, whole = line_dedup.insert(small, df.filter("doc_id >= 100")), line_dedup.build(df)
    cells = lambda s: sum(CuckooFilter.read(r.cells, r.spare).cells.size for r in s.filters.collect())
    assert cells(small) < 550 <= cells(grown) and all(not r.spare for r in grown.filters.collect())
    assert sorted(map(tuple, grown.repeated.collect())) == sorted(map(tuple, whole.repeated.collect())) and grown.repeated.count() == 550
    drops = [{tuple(r) for r in line_dedup.dropped_lines(line_dedup.long_lines(df), s).collect()} for s in (grown, whole)]
    assert drops[0] == drops[1] and len(drops[0]) == 5 * 550


def test_shards_are_those_of_a_plain_sort(spark):
    """Every column of the result, the splitters against the sums of sorted keys, and large groups of empty and null texts."""
    texts = [None if i % 10 < 3 else "" if i % 10 == 3 else f"text {i} " * (1 + i % 9) + "\u00e9" for i in range(12_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in histogram_sort.shard_by_bytes(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()), "bytes", None)
    sizes = Counter()
    for r in rows.values():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8
    for s in range(8):
        assert sorted(r.slot for r in rows.values() if r.shard == s) == list(range(sum(r.shard == s for r in rows.values())))
    assert len({rows[i].shard for i in range(len(texts)) if texts[i] is None}) == 1


def test_large_groups_of_small_texts_are_not_ranked_by_one_task(spark, monkeypatch):
    seen = []
    real = histogram_sort.gapless_rank
    monkeypatch.setattr(histogram_sort, "gapless_rank", lambda df, *a: seen.append((df, a[-1])) or real(df, *a))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 2, F.concat(F.lit("text "), "id")).alias("text"))
    histogram_sort.shard_by_bytes(docs).collect()
    df, n_buckets = seen[0]
    n = sorted(r["count"] for r in df.groupBy("shard", F.floor(F.col("key") / F.lit((1 << 62) // n_buckets + 1))).count().collect())
    assert n[-1] <= 10 * n[len(n) // 2]


def test_splitters_meet_their_targets(spark):
    rng = np.random.default_rng(2)
    keys, sizes = rng.integers(0, 1 << 62, 5000), rng.integers(1, 400, 5000)
    rows = spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist())), "key long, size long")
    targets = [sizes.sum() * (i + 1) / 8 for i in range(7)]
    for slack in (0, 2000):
        for target, key in zip(targets, histogram_sort.find_splitters(rows, targets, slack)):
            below = sizes[keys < key].sum()
            assert abs(below - target) <= max(slack, 400)


def test_languages_are_decoded_as_by_plain_python(spark, monkeypatch):
    """Classifiers and decoding without vectors, on texts of several pieces too; many languages have a code as well."""
    monkeypatch.setattr(lang_id, "LANGS_AT_ONCE", 2)
    words = {"aa": "kalima tolo vesi", "bb": "strunz gefl hoch", "cc": "qué lindo año", "dd": "the thing with them"}
    rows = [(f"{w} {w.split()[i % 3]} {i}", lang) for lang, w in words.items() for i in range(5)]
    model = lang_id.train(spark.createDataFrame(rows + [(None, "aa"), ("x", None)], "text string, lang string"))
    buckets = lambda t: [int(b) for piece in lang_id.trigrams(t) for b in piece]
    counts = {lang: Counter(b for t, x in rows if x == lang for b in buckets(t)) for lang in words}
    total = {lang: sum(c.values()) + lang_id.PRIOR * lang_id.BUCKETS for lang, c in counts.items()}
    p = lambda lang, b: (counts[lang][b] + lang_id.PRIOR) / total[lang]
    code = {lang: model.code[i].tolist() for i, lang in enumerate(sorted(words))}
    mean = lambda xs: sum(xs) / len(xs)
    for text in ("kalima hoch", "the lindo thing", "año 7", "vesi " * 2000):
        monkeypatch.setattr(lang_id, "PIECE", 1000 if len(text) > 1000 else 1 << 18)
        loss = {}
        found = buckets(text)
        for lang in sorted(words):
            loss[lang] = 0.0
            for j in range(len(code[lang])):
                on, off = ([x for x in words if code[x][j] == sign] for sign in (1, -1))
                weight = {b: math.log(mean([p(x, b) for x in on])) - math.log(mean([p(x, b) for x in off])) for b in set(found)} if on and off else Counter()
                margin = sum(weight[b] for b in found) / len(found) * lang_id.SHARPNESS
                loss[lang] += math.log1p(math.exp(-code[lang][j] * margin))
        best = min(loss, key=loss.get)
        told = model.predict(text)
        assert told[0] == best and told[1] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss.values()), abs=1e-5)
    pieces = [list(lang_id.trigrams("abc def" * 400))]
    monkeypatch.setattr(lang_id, "PIECE", 100)
    pieces.append(list(lang_id.trigrams("abc def" * 400)))
    assert np.array_equal(*(np.concatenate(x) for x in pieces)) and len(pieces[1]) > 20
    assert len({tuple(r) for r in lang_id.codewords(600).tolist()}) == 600
