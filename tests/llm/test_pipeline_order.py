"""The mix in the pipeline's result, against a schedule by plain Python."""

import hashlib

import corpus_pipeline
from thriftline.llm import pfair


def schedule(rows, weights, block_rows):
    """(doc_id, slot, offset) of each row (doc_id, source), slot by slot: the released block of the earliest deadline."""
    pools = {}
    for doc_id, source in rows:
        pools.setdefault(source if source in weights else pfair.REST, []).append(doc_id)
    for ids in pools.values():
        ids.sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:15], i))
    names = sorted(pools)
    total = sum(weights[p] for p in names)
    done, out, slot = dict.fromkeys(names, 0), [], 0
    while any(done[p] * block_rows < len(pools[p]) for p in names):
        due = [(-(-(done[p] + 1) * total // weights[p]), p) for p in names if done[p] * total // weights[p] <= slot]
        pool = min(due)[1]
        block = pools[pool][done[pool] * block_rows : (done[pool] + 1) * block_rows]
        out += [(doc_id, slot, i) for i, doc_id in enumerate(block)]
        done[pool] += 1
        slot += 1
    return out


def test_result_carries_the_mix(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id", "source", "mix_slot", "mix_offset").collect()
    want = schedule([(r.doc_id, r.source) for r in got], pfair.WEIGHTS, pfair.BLOCK_ROWS)
    assert len({r.mix_slot for r in got}) > 10
    assert sorted((r.doc_id, r.mix_slot, r.mix_offset) for r in got) == sorted(want)


def test_last_stage_replaces_older_slots(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"src{i % 4}", 7, "x") for i in range(300)], "doc_id long, text string, source string, mix_slot long, note string")
    got = corpus_pipeline.to_pieces(spark, docs, "")
    assert got.columns == ["doc_id", "text", "source", "note", "mix_slot", "mix_offset", "piece_ids", "n_pieces"]
    assert sorted((r.doc_id, r.mix_slot, r.mix_offset) for r in got.collect()) == sorted(schedule([(r.doc_id, r.source) for r in docs.collect()], pfair.WEIGHTS, pfair.BLOCK_ROWS))
