"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thriftline.llm import bm25, chat, histogram_sort, jaccard_join, lang_id, line_dedup, pfair, sentencepiece_fst, url_filter, vp_tree

LONG = "lorem ipsum dolor sit amet consetetur " * 3000
LINE = "this very line is longer than forty characters, truly"
WORDS = " ".join(f"word{i}" for i in range(60))
#: doc_id, text, lang, source, and columns with names that the operators use themselves.
ROWS = [
    (0, None, None, None), (1, "", "en", "src0"), (2, " \n\t ", "en", "src1"), (3, "two words", "en", "src0"), (4, LONG, "en", "src0"), (5, WORDS, "en", "src2"), (6, WORDS, "en", "src2"), (6, WORDS, "en", "src2"),
    (7, WORDS + " more", "en", "nobody"), (8, "123 !?", "en", "src0"), (9, "ÄÖÜ straße\r\nzwei", "de", "src3"), *[(10 + i, f"{LINE}\nown line {i}", "en", "src0") for i in range(6)], (None, WORDS, "en", "src0"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, size string, id string, component string, line string, kept string, score string, rank string, prefix string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "s", "z", "i", "c", "l", "t", "x", "r", "p") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


OPERATORS = {
    "bm25": lambda d: bm25.top_k(d, F.col("doc_id") % 2 == 0), "sentencepiece": lambda d: sentencepiece_fst.coded(d, sentencepiece_fst.load(sentencepiece_fst.default_model())), "sharding": histogram_sort.shard_by_bytes,
    "mix": pfair.mix, "mix order": pfair.in_mix_order, "line dedup": line_dedup.dedup_lines, "jaccard": jaccard_join.similarity_groups, "one of group": jaccard_join.one_of_each_group, "language": lang_id.identify, "accepted": lang_id.accepted,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_edge_rows(spark, docs, empty, stage):
    run = corpus_pipeline.STAGES[stage][1]
    assert run(spark, empty, "").count() == 0
    kept = run(spark, docs, "")
    assert set(docs.columns) <= set(kept.columns) and 0 < kept.count() <= docs.count()


def test_bm25(docs):
    got = bm25.top_k(docs, F.col("doc_id") % 2 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    assert 0 not in by and 2 not in by  # nothing to look for
    first = sorted(by[6])[:3]
    assert [x[:2] for x in first] == [(1, 5), (2, 6), (3, 6)] and len({x[2] for x in first}) == 1  # copies score alike, ties go by id
    assert all(x[1] is not None for v in by.values() for x in v)


def test_sentencepiece_round_trip(docs):
    got = {r.doc_id: r for r in sentencepiece_fst.coded(docs, sentencepiece_fst.load(sentencepiece_fst.default_model())).collect()}
    assert got[0].piece_ids is None and got[0].decoded is None and got[1].piece_ids == []
    assert all(got[i].decoded == got[i].text for i in got if got[i].text is not None)


def test_sharding_keeps_every_row(docs):
    rows = histogram_sort.shard_by_bytes(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in ROWS}
    assert all(r.size == sizes[r.doc_id] for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_mix_keeps_every_row_and_column(docs):
    rows = pfair.mix(docs, {"src0": 3, "src1": 1, "*": 2}, block_rows=2)
    assert rows.count() == len(ROWS) and set(docs.columns) < set(rows.columns)
    got = {r.source: r.mix_pool for r in rows.collect()}
    assert got[None] == "*" and got["nobody"] == "*" and got["src1"] == "src1"


def test_lines(docs):
    got = {}
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id] = (r.n_lines, r.n_dropped, r["kept"])
    assert got[0] == (1, 0, "") and got[1] == (1, 0, "") and got[2] == (2, 0, " \n\t ") and got[4] == (1, 0, LONG)
    assert got[10] == (2, 1, "own line 0") and got[15] == (2, 0, f"{LINE}\nown line 5")


def test_jaccard(docs):
    rows = jaccard_join.similarity_groups(docs).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[0] == (0, 0) and got[2] == (0, 2) and got[3] == (1, 3) and got[6] == (58, 5) and got[7] == (59, 5) and got[None] == (58, None)


def test_language(docs):
    got = {r.doc_id: (r.lang_pred, r["score"]) for r in lang_id.identify(docs).collect()}
    assert got[0] == got[1] == got[2] == got[8] == ("und", 0.0)
    assert got[5][0] == got[4][0] == "en" and all(0 <= s <= 1 for _, s in got.values())


def test_without_labels_all_is_unknown(docs):
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.COM"), (6, "x://a.com/"), (6, "x://a.com/"), (7, "x://www.EXAMPLE.com/en/1?q=/"), (8, "x://m.example.com/en/#a/b"), (9, "x://spam-farm.example.org/"), (10, "x://b.net/fr/"), (None, "x://" + "a" * 100_000)]
    pages = spark.createDataFrame([(*r, "h", "t", "v") for r in rows], "page_id long, url string, host string, token string, verdict string")
    got = url_filter.filter_urls(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None, "allow") and by[5] == ("a.com", "", None, "allow") and by[6] == ("a.com", "/", "com/", "allow")
    assert by[7] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and by[8][2:] == ("example.com/en/", "block") and by[9][2:] == (None, "block") and by[10][2:] == ("net/fr/", "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "~1<s>[b]</s>"), (1, 1, "assistant", "~1<s>[b]</s>"), (1, 2, None, None), (2, 0, "assistant", None), (None, 0, "assistant", "x")]
    conv = spark.createDataFrame([(*r, "t", "s") for r in rows], "conv_id long, turn long, role string, text string, target string, segments string")
    got = {r.conv_id: r for r in chat.digest(chat.expand_targets(conv)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].loss_sha256 == sha("~1<s>[b]</s>" * 2) and got[1].turns_sha256 == sha("user\na\n" + "assistant\n~1<s>[b]</s>\n" * 2 + "\n\n")
    assert got[2].loss_chars == 0 and got[None].loss_sha256 == sha("x")
    assert chat.expand_targets(conv.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.5, 0.5]), (7, [-1.0, -0.0]), (7, [-1.0, 0.0]), (8, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "s", "r") for r in rows], "vec_id long, embedding array<float>, score string, rank string")
    got = vp_tree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 6, 0.5), (0, 4, 7, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 6, 0.5), (20, 4, 7, -1.0)]
    assert vp_tree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_one_id_and_of_other_lengths(spark):
    """Rows are told apart by id and vector; brute force over those of the common length."""
    rows = [(i // 3, [float(i % 7 - 3), float(i % 5), float(i % 11 - 5)]) for i in range(120)] + [(40, [9.0]), (41, [1.0, 2.0])]
    units = sorted({(i, tuple(v)) for i, v in rows if len(v) == 3 and any(v)})
    got = {}
    for r in vp_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=5, factor=1.0).orderBy("query_id", "query_hash", "rank").collect():
        got.setdefault((r.query_id, r.query_hash), []).append((r.vec_id, r["score"]))
    want = []
    for q, x in units:
        if q % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in units if (i, v) != (q, x))[:5]
            want.append((q, [(i, -s) for s, i in found]))
    assert sorted((q, v) for (q, _), v in got.items()) == sorted(want)
