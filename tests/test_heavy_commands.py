"""Commands joined back by broadcast or by shuffle give the same rows."""

import pytest

from thriftline.operators import discovery as op
from thriftline.sources import rules as r

CALLS = [("git status && ls",)] * 50 + [("ls",)] * 40 + [("cargo test; make x",)] * 3 + [("CI=1 npx vitest run",), ("",), (None,), ("  ",), ("echo 'a && b' || git log",), ("cat x | grep y",)]


@pytest.mark.parametrize("heavy", [1, 2, 4096])
def test_heavy_and_other_commands(spark, monkeypatch, heavy):
    monkeypatch.setattr(op, "HEAVY", heavy)
    calls = spark.createDataFrame([(i, *c) for i, c in enumerate(CALLS)], "i long, command string").repartition(4)
    rules = r.rule_table(spark)
    split = sorted((x.i, x.part_index, x.part) for x in op.split_calls(calls).collect())
    want = [(i, k, p) for i, (c,) in enumerate(CALLS) if c is not None for k, p in enumerate({"git status && ls": ["git status", "ls"], "cargo test; make x": ["cargo test", "make x"], "echo 'a && b' || git log": ["echo 'a && b'", "git log"]}.get(c, [c.strip()] if c.strip() else []))]
    assert split == want
    fused = sorted(map(repr, op.classified_calls(calls, rules).select("i", "part_index", "part", *op.KINDS).collect()))
    assert fused == sorted(map(repr, op.classify(op.split_calls(calls), rules).select("i", "part_index", "part", *op.KINDS).collect())) and len(fused) == len(want)
