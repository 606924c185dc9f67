"""Known reports and rules, and what is malformed."""

import datetime
import json

from pyspark.sql import functions as F

from thriftline.functions import json as functions_json
from thriftline.operators import economics, extraction, listing, reduction


def report(depth: int) -> str:
    """A report with one failing test at a depth of suites."""
    run = {"status": "failed", "errors": [{"message": "boom"}]}
    suite = {"title": f"s{depth}", "specs": [{"title": "t", "ok": False, "tests": [{"status": "expected", "results": []}, {"status": "unexpected", "results": [{"status": "passed", "errors": []}, run]}]}]}
    for i in range(depth - 1, 0, -1):
        suite = {"title": f"s{i}", "file": f"f{i}.ts", "specs": [{"title": f"ok{i}", "ok": True}], "suites": [suite]}
    return json.dumps({"suites": [suite], "stats": {"expected": depth - 1, "unexpected": 1, "skipped": 0, "duration": 12.9}})


def test_playwright_reports(spark):
    texts = [report(1), report(8), report(25), "", None, '{"suites": [', "\x1b[31m2 failed\x1b[0m\n3 passed (1.5m)", '{"suites":[],"stats":{"expected":0,"unexpected":0,"skipped":0,"duration":1}}']
    got = {r.output_id: r for r in extraction.playwright(spark.createDataFrame(list(enumerate(texts)), "output_id long, text string")).collect()}
    assert [got[i].parse_tier for i in range(8)] == [1, 1, 1, 3, 3, 3, 2, 1]
    assert [got[i].total for i in range(8)] == [1, 8, 25, 0, 0, 0, 5, 0]
    assert [tuple(f) for f in got[0].failures] == [("t", "s1", "boom")] and got[1].failures[0].file == "s8" and got[2].failures[0].file == "s25"
    assert got[0].duration_ms == 12 and got[6].duration_ms == 90_000 and got[6].failures == [] and got[3].duration_ms is None


def test_go_packages_with_builds_that_fail(spark):
    events = [
        {"Action": "run", "Package": "a", "Test": "T"}, {"Action": "pass", "Package": "a", "Test": "T"}, {"Action": "pass", "Package": "a"}, {"Action": "skip", "Test": "S"},
        {"Action": "build-output", "ImportPath": "b", "Output": "x"}, {"Action": "build-fail", "ImportPath": "b"}, {"Action": "fail", "Package": "b", "FailedBuild": "b"}, {"Action": "fail", "Package": "c"},
    ]
    text = "\n".join(["no JSON", *map(json.dumps, events), '{"Action'])
    got = {r.package: tuple(r)[2:] for r in extraction.go_packages(spark.createDataFrame([(1, text), (2, ""), (3, None)], "output_id long, text string")).collect()}
    assert got == {"a": (1, 1, 0, 0, 0), "unknown": (1, 0, 0, 1, 0), "b": (1, 0, 0, 0, 1), "c": (1, 0, 0, 0, 0), None: (4, 1, 0, 1, 1)}


def test_filter_rules(spark):
    def reduced(text, **rule):
        rules = listing.filter_rules(spark.createDataFrame([(0, json.dumps({"command": "x"} | rule)), (1, "{broken"), (2, '{"command":"y"}')], "line_no int, value string"))
        return listing.apply_filter_rules(spark.createDataFrame([("run x", text)], "command string, text string"), rules).first().reduced

    assert reduced("a\na\nb\na", strategy="group") == "a\nb\na"
    assert reduced("a\na\nb\na", strategy="group", keep_pattern="a") == "a\na\nb\na"
    assert reduced("a\nd\na", strategy="group", drop_pattern="d") == "a"
    assert reduced("a\nb\na", strategy="deduplicate") == "a\nb"
    assert reduced("e1\n2\n3\n4\n", strategy="truncate", max_lines=2, keep_pattern="^e") == "e1\n3\n4"
    assert reduced("1\n2", strategy="truncate") == "1\n2"
    assert reduced("keep d\nd\ne", strategy="filter", keep_pattern="keep", drop_pattern="d") == "keep d\ne"
    assert reduced("", strategy="group") == "" and reduced(None, strategy="group") is None and reduced("a\na\n", strategy="other") == "a\na\n"
    lines = [(0, '{"origin":"user","command":"x","strategy":"filter"}'), (1, '{"origin":"project","command":"x","strategy":"group"}')]
    rules = listing.filter_rules(spark.createDataFrame(lines, "line_no int, value string"))
    assert listing.matching_rule(spark.createDataFrame([("x",), ("z",)], "command string"), rules).orderBy("command").select("rule.strategy").collect() == [("group",), (None,)]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.b.txt").write_text("1234")
    (tmp_path / "Makefile").write_text("x:")
    (tmp_path / "empty").write_text("")
    (tmp_path / ".hidden").write_text("x")
    assert sorted((r.name, r.ext, r.size) for r in listing.file_inventory(spark, str(tmp_path)).collect()) == [("Makefile", None, 2), ("a.b.txt", "txt", 4)]


def test_economics_of_days_that_one_side_lacks(spark):
    day = lambda i: datetime.date(2024, 1, i)
    spent = spark.createDataFrame([(day(1), 10, 1, 0, 0, 11, 2.0), (day(2), 20, 2, 0, 0, 22, 4.0)], f"day date, {', '.join(c + (' double' if c == 'total_cost' else ' long') for c in economics.SPENT)}")
    saved = spark.createDataFrame([(day(2), 3, 50, 100, 50), (day(3), 1, 5, 10, 5)], f"day date, {', '.join(c + ' long' for c in economics.SAVED)}")
    got = {r.day.day: r for r in economics.weighted(economics.merged(spent, saved, "day")).collect()}
    assert got[1].commands is None and got[1].weighted_cpt is None and got[3].total_cost is None and got[3].weighted_savings is None
    assert got[2].savings_pct == 50.0 and got[2].weighted_savings == 50 * 4.0 / 30


def test_markdown(spark):
    texts = ["a\n---\nb", "```\n---\n", "~~~\n<!-- x -->\n~~~\n***\n", "~~~\n---\n```\n---\n```", "![i](u)\n  [![b](c)](d)\nx ![i](u)", "", None, " \n\t"]
    got = reduction.markdown_clean(spark.createDataFrame(list(enumerate(texts)), "output_id long, text string")).orderBy("output_id").collect()
    assert [r.text for r in got] == ["a\n\nb", "```\n---", "~~~\n<!-- x -->\n~~~", "~~~\n```\n---\n```", "x ![i](u)", "", None, ""]


def test_json_truncation(spark):
    long = "s" * 6000
    texts = [json.dumps({"a": "s" * 200}), json.dumps({"a": long}), json.dumps({"error": long}), json.dumps([{"errors": 1}, long]), "{ no", "", None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", functions_json.json_truncate(F.col("text")).alias("x")).orderBy("i").collect()]
    assert [x if x is None else len(x) for x in got] == [208, len('{"a":"' + "s" * 100 + '...(6000chars)"}'), 6012, len('[{"errors":1},"' + "s" * 100 + '...(6000chars)"]'), 4, 0, None]
