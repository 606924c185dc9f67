"""Findings of round 4, each with a small input that failed before."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_results import brute_force, shard_of
from thriftline.llm import bm25
from thriftline.llm.common import table

SF = "/root/testdata/sf0.001"


def two_languages(n):
    """Texts of two languages by turns, with a few words and numbers in common."""
    rng = np.random.default_rng(4)
    return [" ".join([f"{'ab'[i % 2]}word{w}" for w in rng.zipf(1.3, 40 + i % 60) % 3000] + [f"shared{w}" for w in rng.integers(0, 50, 4)]) for i in range(n)]


def test_shards_rule_out_queries_of_another_kind(spark):
    texts = two_languages(1200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bm25.analysed(docs)
    shards = [pickle.loads(r["index"]) for r in bm25.build_shards(rows, rows.agg(F.avg("length")).first()[0]).collect()]
    assert sorted(i for s in shards for i in s.ids.tolist()) == list(range(1200))
    assert all(len(set((s.ids % 2).tolist())) == 1 for s in shards)
    assert all((np.diff(s.lengths) >= 0).all() for s in shards)
    whole, queries = shard_of(texts)
    for shard in shards:
        for i in range(0, 1200, 60):
            terms, idf = queries[i]
            least = whole.search(terms, idf, 10)[1][-1]
            shard.held = shard.touched = 0
            found = shard.search(terms, idf, 10, least - 1e-6)
            if i % 2 != shard.ids[0] % 2:
                assert not len(found[0]) and shard.held and not shard.touched


@pytest.mark.parametrize("settings", [{}, {"GROUP": 7, "BLOCK_CELLS": 500, "BLOCK_DOCS": 16, "SLICE": 4}, {"DENSE_TERMS": 0, "BOUND_CELLS": 4000}, {"DENSE_SHARE": 200, "STEP": 900}])
def test_queries_find_together_what_each_finds_alone(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(bm25, k, v)
    docs = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()] + two_languages(400) + ["one", "one two", "one"]
    shard, queries = shard_of([t for t in docs if bm25.terms_of(t)[2]])
    queries = queries[::5] + queries[-3:]
    terms, first, members = np.unique(np.concatenate([t for t, _ in queries]), return_index=True, return_inverse=True)
    shard.prepare(terms, np.concatenate([w for _, w in queries])[first])
    want = [brute_force(shard, *q) for q in queries]
    for least in (np.zeros(len(queries)), np.array([w[1][-1] - 1e-6 for w in want]), np.array([w[1][-1] * 0.6 for w in want])):
        found = {i: (ids.tolist(), scores.tolist()) for i, ids, scores in shard.search_all(members, np.cumsum([len(t) for t, _ in queries]), least, 10)}
        assert [found[i] for i in range(len(queries))] == want
