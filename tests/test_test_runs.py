"""Test runs, trees and manifests by rule: reports with banners, deep trees, failure blocks, and what does not fit."""

import json
import random

import pytest
from pyspark.sql import functions as F

from thriftline.functions import json as j
from thriftline.operators import extraction, manifests, reduction, scan, testruns, trees


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "output_id long, text string")


def lines(spark, *texts):
    return extraction.lines_of(frame(spark, *texts).filter("text is not null"))


def by_id(df):
    return {r.output_id: r for r in df.collect()}


REPORT = json.dumps({"numTotalTests": 3, "numPassedTests": 2, "numFailedTests": 1, "numPendingTests": 0, "startTime": 10, "endTime": 460, "testResults": [{"name": "a.ts", "assertionResults": [{"fullName": "x }", "status": "passed", "failureMessages": []}, {"fullName": "y {", "status": "failed", "failureMessages": ["e1 \" }", "e2"]}]}]})


def test_vitest_behind_banners(spark):
    banners = ["", "Scope: all 6 workspace projects\n WARN  deprecated\n\n", "[dotenv@17.2.4] injecting env (0) from .env\n\n", "> run {x}\n", '{"a": 1}\n', "} {\n"]
    got = by_id(testruns.vitest(frame(spark, *[b + REPORT + "\ntail }" * bool(b) for b in banners], "Tests  1 failed | 4 passed (5)\n FAIL a > b\n  boom\n   more\nx\n Duration  1.20s", "\x1b[32mTests\x1b[0m  7 passed", "nothing {", "", None, '{"numTotalTests": 3')))
    for i in range(len(banners)):
        r = got[i]
        assert (r.total, r.passed, r.failed, r.skipped, r.duration_ms, r.passed_names, r.parse_tier) == (3, 2, 1, 0, 450, ["x }"], 1), banners[i]
        assert [tuple(f) for f in r.failures] == [("y {", "a.ts", 'e1 " }\ne2')]
    assert (got[6].total, got[6].failed, got[6].duration_ms, got[6].parse_tier) == (5, 1, 1200, 2) and [tuple(f) for f in got[6].failures] == [(" FAIL a > b", "", "boom\nmore")]
    assert (got[7].total, got[7].duration_ms, got[7].parse_tier) == (7, None, 2)
    assert [(got[i].total, got[i].parse_tier) for i in range(8, 12)] == [(0, 3)] * 4


def random_tree(rng, depth):
    node = {"version": f"{depth}.0"} if rng.random() < 0.9 else {}
    for kind in ("dependencies", "devDependencies"):
        if depth and rng.random() < 0.7:
            node[kind] = {f"{kind[0]}{depth}_{i}": random_tree(rng, depth - 1 if i == 0 else min(depth - 1, 2)) for i in range(rng.randrange(1, 3))}
    return node


def packages_by_hand(name, node, dev):
    out = [(name, node["version"], dev)] if "version" in node else []
    for n, child in node.get("dependencies", {}).items():
        out += packages_by_hand(n, child, dev)
    for n, child in node.get("devDependencies", {}).items():
        out += packages_by_hand(n, child, True)
    return out


def test_trees_of_any_depth(spark):
    rng, chain = random.Random(6), {"version": "0"}
    for i in range(45):
        chain = {"version": str(i), "dependencies": {f"c{i}": chain}}
    docs = [{f"r{k}": random_tree(rng, rng.randrange(12)) for k in range(3)} for _ in range(20)] + [{"chain": chain}, {"express": {"version": "4.18.2", "dependencies": {"x": {"version": "1"}}}}, {}]
    got = {}
    for r in trees.pnpm_packages(frame(spark, *map(json.dumps, docs))).collect():
        got.setdefault(r.output_id, []).append((r.name, r.version, r.dev))
        assert r.parse_tier == 1
    for i, doc in enumerate(docs):
        assert sorted(got.get(i, [])) == sorted(p for n, node in doc.items() for p in packages_by_hand(n, node, False))


def test_listings_as_text(spark):
    text = "Legend: production\nexpress@4.18.2 extra\n@scope/a@1.0\n├── no@1\n\nplain\n@\nx@"
    got = trees.pnpm_packages(frame(spark, text, None, "", '{"a": 1}', "[]", "{")).collect()
    assert sorted((r.output_id, r.name, r.version, r.parse_tier) for r in got) == [(0, "@scope/a", "1.0", 2), (0, "express", "4.18.2", 2)]
    assert trees.pnpm_packages(frame(spark, text).limit(0)).count() == 0
    same = spark.createDataFrame([(1, '{"a":{"version":"1"}}'), (1, '{"a":{"version":"1"}}'), (None, '{"b":{"version":"2"}}')], "output_id long, text string")
    assert sorted(map(repr, trees.pnpm_packages(same).select("output_id", "name").collect())) == ["Row(output_id=1, name='a')", "Row(output_id=1, name='a')", "Row(output_id=None, name='b')"]


def test_outdated_packages(spark):
    full = json.dumps({"a": {"current": "1", "latest": "2", "wanted": "1", "dependencyType": "devDependencies"}, "b": {"current": "1", "latest": "1"}})
    text = "Package Current Wanted Latest\n┌────┐\nc  1.0  1.5   2.0  x\ntoo few words\nLegend: a b c d"
    got = trees.pnpm_outdated(frame(spark, full, text, '{"a":{"current":"1"}}', None)).collect()
    assert sorted(tuple(r) for r in got if r.wanted) == [(0, "a", "1", "2", "1", True, 1), (1, "c", "1.0", "2.0", "1.5", False, 2)] and sum(r.wanted is None for r in got) == 1


@pytest.mark.parametrize("size", [2, 65536])
def test_quick_counts(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "CHUNK_LINES", size)
    texts = ["10 passed", "3 failed tests\n✗ a\n0 failed\nFAIL b", "ok\n4 passed\nok\nall ok", "2 skipped\n5 ignored", "passed\nx passed\n99999999999999999999999 passed", "none", "7 tests passed\n12   PASSED"]
    got = by_id(testruns.quick_tests(lines(spark, *texts)))
    assert [(got[i].passed, got[i].failed, got[i].skipped) for i in range(7)] == [(10, 0, 0), (0, 0, 0), (6, 0, 0), (0, 0, 5), (3, 0, 0), (0, 0, 0), (12, 0, 0)]
    assert got[1].failures == ["3 failed tests", "✗ a", "FAIL b"]


def event(action, test="T", output=None, package="p"):
    return json.dumps({"Action": action, "Test": test, "Output": output, "Package": package})


def test_output_before_a_failure(spark):
    text = "\n".join([event("output", output="a  \n"), "no event", event("output", "U", "u\n"), event("fail"), event("output", output="late\n"), event("fail"), event("output", output="after\n"), event("fail", "V", package=None), event("pass", "U")])
    got = testruns.failed_test_output(testruns.go_events(lines(spark, text))).collect()
    assert sorted((r.package, r.test, r.nth, r.output) for r in got) == [("p", "T", 1, ["a"]), ("p", "T", 2, ["late"]), ("unknown", "V", 1, [])]


def test_failure_blocks(spark):
    pytest_text = "=== test session starts ===\n___ no ___\n=== FAILURES ===\n___ test_a ___\n\n    def t():\n>   assert 1\nE   AssertionError: x\nE   more\n\na/b.py:12: AssertionError\n___ test_b[1] ___\nplain\n=== short test summary info ===\nFAILED x\n=== 2 failed ==="
    got = testruns.pytest_blocks(lines(spark, pytest_text)).orderBy("place").collect()
    assert [(r.name, r.message, r.location, r.relevant) for r in got] == [("test_a", "AssertionError: x", "a/b.py:12", [">   assert 1", "E   AssertionError: x", "E   more"]), ("test_b[1]", None, None, [])]
    cargo = "running 2 tests\ntest a ... ok\ntest b ... FAILED\n\nfailures:\n\n---- b stdout ----\nthread panicked\n   0: std::x\n   1: /rustc/y\n   2: mine\n\nfailures:\n    b\n\ntest result: FAILED. 1 passed; 1 failed\nafter"
    got = testruns.cargo_blocks(lines(spark, cargo)).orderBy("place").collect()
    assert [(r.name, r.body) for r in got] == [("---- b stdout ----", "thread panicked\n   ... (2 internal frames)\n   2: mine"), ("    b", "")]
    nextest = "    Starting 3 tests across 1 binary\n    PASS [ 0.1s] a t\n    FAIL [ 0.2s] a u\n  stdout ───\n    boom\n────\n    PASS [ 0.1s] a v\n  lost\n     Summary [ 0.5s] 3 tests run: 2 passed, 1 failed, 4 skipped\n    FAIL [ 0.2s] a u\n"
    assert [(r.name, r.body) for r in testruns.nextest_blocks(lines(spark, nextest)).collect()] == [("FAIL [ 0.2s] a u", "  stdout ───\n    boom")]
    assert [tuple(r) for r in testruns.nextest_summary(lines(spark, nextest)).collect()] == [(0, 0.5, 3, 2, 1, 4)]
    for f in (testruns.pytest_blocks, testruns.cargo_blocks, testruns.nextest_blocks, testruns.nextest_summary, testruns.quick_tests):
        assert f(lines(spark, "").limit(0)).count() == 0 and f(lines(spark, "nothing", None)).drop("output_id").count() in (0, 1)


MANIFESTS = {
    "cargo": '[package]\nname = "no"\n[dependencies]\na = "1.0"\nb = { version = "2", features = [] }\nc = { path = ".." }\n[dev-dependencies]\nd="3"\n[profile.x]\ne = "4"',
    "package_json": '{"name":"x","dependencies":{"a":"^1","b":2},"devDependencies":{"c":"3"},"scripts":{"d":"e"}}',
    "requirements": "# c\na==1.0\nb>=2,<3\n  c  \n-r other\n\nd[extra]==1",
    "pyproject": "[project]\ndependencies = [\n  'a>=1',\n  \"b\",\n]\n[x]\nother-dependencies = [\n 'c',\n]",
    "gomod": "module m\n\ngo 1.21\n\nrequire x.com/a v1.0.0\n\nrequire (\n\tx.com/b v2.0.0 // indirect\n\t// x.com/no v0\n)\n\nreplace x.com/q => y\n",
}


def test_five_kinds_of_manifests(spark):
    files = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(MANIFESTS.items())] + [(9, "other", "a==1"), (10, "package_json", "{broken"), (11, "cargo", "")], "output_id long, kind string, text string")
    rows = files.select("output_id", "kind", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    got = {}
    for r in manifests.dependencies(files, rows).collect():
        got.setdefault(r.kind, []).append((r.section, r.name, r.version))
    assert {k: sorted(v) for k, v in got.items()} == {
        "cargo": [("dependencies", "a", "1.0"), ("dependencies", "b", "2"), ("dev-dependencies", "d", "3")], "package_json": [("dependencies", "a", "^1"), ("dependencies", "b", "*"), ("devDependencies", "c", "3")],
        "requirements": [("packages", "a", "==1.0"), ("packages", "b", ">=2,<3"), ("packages", "c", "")], "pyproject": [("dependencies", "a", ">=1"), ("dependencies", "b", "")], "gomod": [("require", "x.com/a", "v1.0.0"), ("require", "x.com/b", "v2.0.0")],
    }


def test_status_lines(spark):
    got = by_id(extraction.change_counts(frame(spark, "## main\nAU x\nUU y\nM  z\n M w\n?? v\nx\nMM q", "UU first", "")))
    assert [(got[i].staged, got[i].modified, got[i].untracked, got[i].conflicts) for i in (0, 1)] == [(3, 2, 1, 1), (0, 0, 0, 0)]


def test_outlines_of_json():
    assert j.outline({"name": "test", "count": 42}) == "{\n  count: int,\n  name: string\n}"
    assert j.outline({"items": [1, 2, 3]}) == "{\n  items:\n  [int] (3)\n}"
    assert j.outline({"a": [{"b": None}], "u": "http://x", "d": "2024-01-01", "s": "é" * 26, "f": 2**63}) == "{\n  a:\n  [\n    {\n      b: null\n    }\n  ]\n  d: date?,\n  f: float,\n  s: string[52],\n  u: url\n}"
    many = j.outline({f"k{i:02}": True for i in range(20)})
    assert many.endswith("  k15: bool,\n  ... +4 more keys\n}") and j.outline({f"k{i:02}": 1 for i in range(15)}).endswith("  k14: int\n}")
    assert j.outline({"a": {"b": {"c": {}}}}, 0, 1) == "{\n  a:\n  {\n    b:\n    ...\n  }\n}"


def test_forms_of_texts(spark):
    texts = ['{"a": [1, {"b": " x  y "}], "c": null, "d": ""}', " one \n\n two", "", "[true, 2.5]", "null"]
    got = {i: r for i, r in enumerate(frame(spark, *texts).select("output_id", j.json_flat(F.col("text")).alias("f")).orderBy("output_id").collect())}
    assert [got[i].f for i in range(5)] == ["a[0]:1|a[1].b:x y|c:null", "one|two", "", "0:true|1:2.5", ""]
    rows = reduction.compact_forms(frame(spark, "a" * 400, '{"a":    1}', "")).collect()
    assert all(r.savings_pct >= 0 for r in rows) and {r.savings_pct for r in rows if r.format == "raw"} == {0.0}


def test_word_counts_and_their_total(spark):
    got = sorted(map(tuple, reduction.with_total(reduction.word_counts(frame(spark, "a b\nc\n", "é", ""))).collect()), key=repr)
    assert got == [(0, 2, 3, 6, 6), (1, 0, 1, 2, 1), (2, 0, 0, 0, 0), (None, 2, 4, 8, 7)]
    assert [tuple(r) for r in reduction.with_total(reduction.word_counts(frame(spark, "a").limit(0))).collect()] == [(None, 0, 0, 0, 0)]
