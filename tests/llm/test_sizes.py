"""The same results at both sides of what used to be a limit of size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thriftline.llm import jaccard_join, lang_id, line_dedup, vp_tree
from thriftline.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 512, 513, 3000])
def test_no_two_languages_share_a_codeword(n):
    code = lang_id.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0} and len({c.tobytes() for c in code}) == n
    if n > 7:
        m = (n - 1).bit_length()
        some = range(n) if n < 600 else np.random.default_rng(0).choice(n, 300, replace=False)
        assert min((code[i] != code[j]).sum() for i in some for j in some if i < j) >= min(4 * m, 2 ** (m - 1))


@pytest.mark.parametrize("shard", [8192, 150])
def test_neighbours_over_several_shards_and_lengths(spark, monkeypatch, shard):
    monkeypatch.setattr(vp_tree, "SHARD_VECTORS", shard)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=n)]) for n, count in ((8, 500), (3, 120), (1, 30)) for i in rng.choice(5000, count, replace=False)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in vp_tree.nearest(df, F.col("vec_id") % 5 == 0, k=7, factor=1.0).orderBy("query_id", "query_hash", "rank").collect():
        got.setdefault((r.query_id, r.query_hash), []).append((r.vec_id, round(r["score"], 9)))
    want = []
    for q, v in rows:
        if q % 5 == 0:
            found = sorted((-np.dot(v, w), i) for i, w in rows if len(w) == len(v) and (i, w) != (q, v))[:7]
            want.append((q, [(i, round(-s, 9)) for s, i in found]))
    assert sorted((q, v) for (q, _), v in got.items()) == sorted(want)


def test_a_line_in_every_document_is_dealt_to_many_groups(spark, monkeypatch):
    """One shard has nearly all lines: its groups are no larger than those of the others allow."""
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 500)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    common, own = "this line is in every document there is, all of them", F.concat(F.lit("this line of forty characters is of group "), F.col("id") % 300)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{common}\n"), own).alias("text"))
    long = line_dedup.long_lines(docs)
    state = line_dedup.build(docs, long=long)
    assert state.n_shards > 10
    kept = line_dedup.probe(long, state)
    assert kept.count() == 12_000
    plan = []
    real = line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name, *a, **k: plan.append((name, made := real(df, name, *a, **k))) or made)
    line_dedup.probe(long, state)
    salts = {r.shard: r.salts for r in dict(plan)["line-shards"].collect()}
    sizes = {r.shard: r["count"] for r in long.groupBy(line_dedup.shard_of(state.n_shards).alias("shard")).count().collect()}
    assert all(sizes[s] / salts[s] <= 500 for s in sizes) and max(salts.values()) >= 12
    got = line_dedup.dedup_lines(docs)
    assert got.filter("n_dropped = 2").count() == 5700 and got.filter("n_dropped = 0").count() == 1


def test_shards_grow_with_their_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
    text = F.concat(F.lit("a line of more than forty characters, number "), F.floor(F.col("id") / 6))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), text.alias("text"))
    state = line_dedup.build(docs.filter("doc_id < 60"))
    grown = line_dedup.insert(state, docs.filter("doc_id >= 60"))
    assert state.n_shards == 1 and grown.n_shards == 15 and grown.filters.count() == 15
    long = line_dedup.long_lines(docs)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(line_dedup.apply(docs, grown, long)) == key(line_dedup.dedup_lines(docs))


def test_lists_of_shingles_that_are_not_known_as_frequent(spark, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    want = sorted(map(tuple, jaccard_join.similarity_groups(docs).collect()))
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", 0)
    monkeypatch.setattr(jaccard_join, "LIST_PART", 3)
    assert sorted(map(tuple, jaccard_join.similarity_groups(docs).collect())) == want


def test_one_row_of_repeated_ones_stays(spark):
    w = " ".join(f"word{i}" for i in range(40))
    rows = [(5, w, "a"), (5, w, "b"), (None, w, "c"), (None, w, "d"), (9, w, "e"), (None, "only here " + w, "f"), (None, "only here " + w, "g"), (7, None, "h"), (7, None, "i"), (8, None, "j"), (6, "", "k"), (6, "", "l"), (4, "x", "m"), (4, "y", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    for run in (jaccard_join.one_of_each_group, lambda d: corpus_pipeline.one_of_near_copies(spark, d, "")):
        got = sorted(((r.doc_id, r.text) for r in run(docs).collect()), key=repr)
        assert got == sorted([(5, w), (None, "only here " + w), (7, None), (8, None), (6, ""), (4, "x"), (4, "y")], key=repr)
    assert jaccard_join.one_of_each_group(docs.limit(0)).count() == 0
