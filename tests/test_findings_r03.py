"""Findings of round 3, each with a small input that failed before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from thriftline import catalog
from thriftline.operators import listing


def test_outputs_of_no_tokens_stay_as_they_are(spark):
    pairs = spark.createDataFrame([(0, 0, 5, False), (0, 3, 5, True), (100, 0, 5, False), (100, 50, 5, False), (None, 1, 1, False)], "raw_tokens long, reduced_tokens long, raw_lines long, degraded boolean")
    got = [(r.raw_tokens, r.status, r.tokens) for r in listing.validated(pairs).collect()]
    assert got == [(0, "reduced", 0), (0, "reduced", 3), (100, "raw", 100), (100, "reduced", 50), (None, "reduced", 1)]


def test_statuses_of_commands_without_tokens(spark, tmp_path):
    events = "select id as event_id, timestamp'2024-01-01' as ts, id % 5 as user_id, 'view' as event_type, if(id % 2 = 0, 0D, id * 1.5D) as value, '' as props from range(40)"
    spark.sql(events).write.parquet(str(tmp_path / "events.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    name = "fn_validate_reduction"
    assert differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path)) == []


#: A text that begins with a JSON value and goes on.
BEGINS_WITH_JSON = '82948 Inly onhe.\n\n  Hasttion  nthe\n{"a":1} and more\n'


@pytest.fixture(scope="module")
def forms(spark):
    texts = spark.createDataFrame([(1, BEGINS_WITH_JSON), (2, '{"b": 1} {"a": 2}'), (3, ' {"b": 1,\n "a": 82948}\n'), (4, None), (5, " 82948 ")], "output_id long, text string")
    return texts


def test_texts_that_begin_with_json_are_compacted_whole(spark, forms):
    from thriftline.functions import json as j

    got = {r.output_id: (r.c, r.f) for r in forms.select("output_id", j.compact_json(F.col("text")).alias("c"), j.json_flat(F.col("text")).alias("f")).collect()}
    assert got[1] == ('82948 Inly onhe. Hasttion nthe {"a":1} and more', '82948 Inly onhe.|Hasttion  nthe|{"a":1} and more')
    assert got[2] == ('{"b": 1} {"a": 2}', '{"b": 1} {"a": 2}')
    assert got[3] == ('{"a":82948,"b":1}', "b:1|a:82948") and got[4] == (None, None) and got[5][0] == "82948"


def test_forms_of_texts_that_begin_with_json(spark, forms):
    from thriftline.operators.reduction import compact_forms

    got = {r.format: (r.tokens, r.savings_pct) for r in compact_forms(forms.filter("output_id = 1")).collect()}
    assert got == {"raw": (13, 0.0), "compact": (12, pytest.approx(100 - 1200 / 13)), "flat": (12, pytest.approx(100 - 1200 / 13))}


def test_numbers_beyond_a_double_are_no_json(spark):
    from thriftline.functions import json as j

    texts = ["1e400", "[1,  -1e999]", "9" * 400, "[" * 990 + "1" + "]" * 990, "[1e300]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = [(r.c, r.f) for r in rows.select("i", j.compact_json(F.col("text")).alias("c"), j.json_flat(F.col("text")).alias("f")).sort("i").collect()]
    assert got[:3] == [("1e400", "1e400"), ("[1, -1e999]", "[1,  -1e999]"), ("9" * 400, "9" * 400)]
    assert got[3] == (texts[3], texts[3]) and got[4][1] == "0:1e+300"  # what is nested too deep to be walked fails no job


def test_forms_of_texts_with_blanks_of_all_kinds(spark, tmp_path):
    texts = [None, "", " \u3000\n\x0b", "\u00a0a \x0b\u2003b\x0b\n\u0085 c\u3000\n\u2028\n", "a\x0b\x0b\x0b\x0bb", "\u1680\u202f\u205f\u2009 a", "1e400", "82948 a\r\n b\r\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(20).write.parquet(str(tmp_path / "events.parquet"))
    con = connect("/root/testdata/sf0.001")
    for t in ("documents", "events"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    name = "join_format_compare"
    assert differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path)) == []
    got = {(r.output_id, r.format): r.tokens for r in catalog.queries()[name](spark, str(tmp_path)).filter("output_id in (3, 4, 5)").collect()}
    assert got == {(3, "raw"): 4, (3, "compact"): 2, (3, "flat"): 2, (4, "raw"): 2, (4, "compact"): 1, (4, "flat"): 2, (5, "raw"): 2, (5, "compact"): 1, (5, "flat"): 1}


def test_pruned_texts_stay_json_and_whole(spark):
    from thriftline.functions import json as j

    same = ["1e400", '{"a":-1e999,"b":null}', '{"a":NaN,"b":null}', '{"a":Infinity,"b":null}', "[" * 100_000, '{"a":null} x', None]
    cut = {r'{"a":"\ud83d\ude00","b":"\ud800x","c":null}': '{"a":"\U0001f600","b":"\\ud800x"}', r'{"\udfff":[1.50,null],"c":null}': r'{"\udfff":[1.5,null]}', '{"a":' + "9" * 400 + ',"b":null}': '{"a":' + "9" * 400 + "}"}
    rows = spark.createDataFrame(list(enumerate([*same, *cut])), "i long, text string")
    got = [tuple(r) for r in rows.select("i", j.json_prune(F.col("text")), j.json_truncate(F.col("text"))).sort("i").collect()]
    assert [r[1] for r in got] == [*same, *cut.values()]
    assert [r[2] for r in got[: len(same)]] == same and got[7][2] == '{"a":"\U0001f600","b":"\\ud800x","c":null}'


def test_all_pods_that_are_not_well_are_named(spark):
    from thriftline.operators import sections

    rows = spark.createDataFrame([(1, "b", "Failed", 2, True), (1, "a", "Pending", 0, True), (1, "c", "Running", 1, False), (2, "d", "Running", 0, False)], "output_id long, name string, phase string, restarts long, issue boolean")
    got = {r.output_id: (r.running, r.pending, r.failed, r.restarts, r.issues) for r in sections.pod_counts(rows).collect()}
    assert got == {1: (1, 1, 1, 3, ["a", "b"]), 2: (1, 0, 0, 0, [])}


def test_lint_runs_keep_their_errors(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.severity, r.code[:2]): r["count"] for r in catalog.queries()["ext_clippy"](spark, sf).groupBy("severity", "code").count().groupBy("severity", F.substring("code", 1, 2).alias("code")).agg(F.sum("count").alias("count")).collect()}
    want = {(r.s, r.c): r.n for r in spark.read.parquet(f"{sf}/events.parquet").filter("event_id % 8 > 1").groupBy(F.expr("if(event_id % 3 = 0, 'error', 'warning')").alias("s"), F.expr("if(event_id % 3 = 0, 'E0', 'W0')").alias("c")).agg(F.count("*").alias("n")).collect()}
    assert got == want and len(got) == 2


def test_the_telemetry_document_is_read_back_whole(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog.queries()["sink_telemetry_doc"](spark, sf).collect()
    days = spark.read.parquet(f"{sf}/events.parquet").select(F.expr("to_date(cast(ts as timestamp) + make_ym_interval(0, cast(user_id % 3 as int)))")).distinct().count()
    assert {r.part: r.n for r in rows} == {"summary": 1, "projects": 10, "commands": 5, "days": 30} and days > 30
    assert len(rows) == 1 + 10 + 5 + 30 and all(r.saved_tokens is not None for r in rows)
    by = {p: [r for r in sorted(rows, key=lambda r: r.place) if r.part == p] for p in ("summary", "commands")}
    assert sum(r.saved_tokens for r in by["commands"]) == by["summary"][0].saved_tokens and by["commands"][0].saved_tokens >= by["commands"][1].saved_tokens


def test_many_sessions_share_a_few_log_files(spark, tmp_path):
    from thriftline.sources import sessions

    lines = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 1000).alias("session_id"), F.floor(F.col("id") / 1000).alias("line_no"), F.concat(F.lit("a\tb"), "id").alias("value"))
    sessions.write_session_lines(lines, str(tmp_path / "logs"), F.concat(F.lit("p"), F.substring("session_id", 2, 1)))
    files = list((tmp_path / "logs").rglob("*.txt"))
    assert len(files) <= 8 * 10 and {f.parent.name for f in files} == {f"project=p{i}" for i in range(10)}
    back = sessions.of_many_sessions(sessions.read_session_lines(spark, str(tmp_path / "logs"), suffix=".txt"))
    got = {r.session_id: r.v for r in back.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("v")).collect()}
    assert got == {f"s{i}": [f"a\tb{i + 1000 * k}" for k in range(3)] for i in range(1000)}


def test_projects_of_packed_logs_are_pruned(spark, tmp_path):
    from thriftline.sources import sessions

    lines = spark.range(600).select((F.col("id") % 200).cast("string").alias("session_id"), F.floor(F.col("id") / 200).alias("line_no"), F.lit("x").alias("value"))
    sessions.write_session_lines(lines, str(tmp_path / "logs"), F.concat(F.lit("-w-p"), F.col("session_id").cast("long") % 4))
    back = sessions.read_session_lines(spark, str(tmp_path / "logs"), "2020-01-01T00:00:00", "project=-w-p1", ".txt")
    assert back.select("session_id").distinct().count() <= 8
    got = {(r.session_id, r["count"]) for r in sessions.of_many_sessions(back).groupBy("session_id").count().collect()}
    assert got == {(str(i), 3) for i in range(1, 200, 4)}


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["udf_filter_strategy", "udf_plugin_filter", "fn_structure_preservation", "fn_json_prune"])
def test_workers_hold_few_texts_at_a_time(spark, name):
    plan = planned(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("heavy", [1, 2, 4096])
def test_rules_of_heavy_and_other_commands(spark, monkeypatch, heavy):
    monkeypatch.setattr(listing, "HEAVY", heavy)
    commands = ["cargo test"] * 9 + ["npm run"] * 5 + [None] * 7 + ["make", "", "npm i"]
    outputs = spark.createDataFrame([(i, c) for i, c in enumerate(commands)], "i long, command string").repartition(3)
    rules = spark.createDataFrame([(1, "cargo test", "a"), (2, "cargo", "b"), (3, "npm", "c")], "priority int, command string, strategy string")
    got = {r.i: (r.command, r.rule.strategy if r.rule else None) for r in listing.matching_rule(outputs, rules).collect()}
    assert got == {i: (c, {"cargo test": "a", "npm run": "c", "npm i": "c"}.get(c)) for i, c in enumerate(commands)}


def test_texts_are_not_dealt_by_command(spark):
    plan = planned(catalog.queries()["src_filter_rules"](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin [coalesce(command" in plan and "LeftAnti" in plan


def test_listings_are_walked_without_a_shuffle(spark):
    from thriftline.operators import trees

    tree = '{"a":{"version":"1","dependencies":{"b":{"version":"2","devDependencies":{"c":{}}}}}}'
    rows = spark.createDataFrame([(1, tree), (1, tree), (2, tree), (None, tree), (3, "x@1"), (4, None)], "output_id long, text string")
    found = trees.pnpm_packages(rows)
    assert "Exchange" not in planned(found) and "Join" not in planned(found)
    got = sorted((str(r.output_id), r.name, r.version, r.dev, r.parse_tier) for r in found.collect())
    assert got == sorted([(i, n, v, False, 1) for i in ("1", "1", "2", "None") for n, v in (("a", "1"), ("b", "2"))] + [("3", "x", "1", False, 2)])


def test_calls_and_results_are_read_once(spark):
    from thriftline.sources import sessions

    rows = spark.createDataFrame(
        [("s", "i", 1, "a", None), ("s", "i", 2, None, (1, "x", True)), ("s", "i", 3, None, (2, "yy", False)), ("s", "j", 4, "b", None), ("s", "i", 5, "c", None), ("t", "j", 6, None, (1, "z", True))],
        "session_id string, id string, at int, command string, result struct<output_len:long,output_content:string,is_error:boolean>",
    )
    got = [tuple(r) for r in sessions.paired(rows).orderBy("sequence_index").collect()]
    assert got == [("s", 0, "a", 2, "yy", False), ("s", 1, "b", None, None, False), ("s", 2, "c", 2, "yy", False)]
    plan = planned(catalog.queries()["src_session_a"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Scan parquet") == 1 and "Join" not in plan


#: Lines on which the states of manifests turn, and some that only look so.
TURNS = {
    "cargo": ["[dependencies]", "[dev-dependencies] # x", " [dependencies]", "[]", "[x", "[a]b]", 'a = "1"', 'b = { version = "2" }', "\rc = 1", "", "[dependencies\r]", 'd ="3"', ' [dev-dependencies]', "]"],
    "pyproject": ["dependencies = [", "[x] dependencies", "[dependencies", "  ]\r", "]", "] ]", "'a>=1',", ' "b[x] ==2",', "", " ]", "other = [", "c", "dependencies"],
    "gomod": ["module x", "go 1", "require (", "\trequire (\r", "require  (", ")", " ) ", ") x", "a v1 // y", "// a v1", "require b v2", "require c", "", "module require (", " )", "go )"],
    "requirements": ["a==1", "# b", " c ", "-r d", "", "e\r", "f "],
}


def test_manifests_of_texts_and_of_lines_tell_the_same(spark):
    import random

    from thriftline.operators import manifests

    dice = random.Random(9)
    texts = [(k, "\n".join(dice.choice(lines) for _ in range(dice.randrange(12)))) for k, lines in TURNS.items() for _ in range(400)]
    files = spark.createDataFrame([(i, *t) for i, t in enumerate([*texts, *((k, None) for k in TURNS)])], "output_id long, kind string, text string").repartition(8).cache()
    lines = files.select("output_id", "kind", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    told = manifests.dependencies(files)
    assert "Window" not in planned(told)
    got, want = (sorted(map(tuple, df.collect())) for df in (told, manifests.dependencies(files, lines)))
    assert got == want and {r[1] for r in got} == set(TURNS) and len(got) > 1000


def test_manifests_are_walked_without_sorting_lines(spark):
    plan = planned(catalog.queries()["ext_manifest_deps"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "Join" not in plan


def test_packed_logs_are_read_once_and_in_order(spark, tmp_path):
    from thriftline.sources import sessions

    lines = spark.range(4000).select((F.col("id") % 40).cast("string").alias("session_id"), F.floor(F.col("id") / 40).alias("line_no"), F.floor(F.col("id") / 40).cast("string").alias("value"))
    sessions.write_session_lines(lines, str(tmp_path / "logs"), F.lit("p"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "700")
    try:
        read = sessions.read_session_lines(spark, str(tmp_path / "logs"), suffix=".txt", numbered=False)
        plan = planned(read)
        assert plan.count("Scan text") == 1 and "Join" not in plan and "Window" not in plan and "Exchange" not in plan
        assert read.select("line_no.split").distinct().count() > 8
        rows = sessions.of_many_sessions(read).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("v")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.session_id: r.v for r in rows} == {str(i): [str(k) for k in range(100)] for i in range(40)}


@pytest.mark.parametrize("name", ["src_session_prune", "src_session_cwd"])
def test_queries_of_log_files_read_them_once(spark, name):
    plan = planned(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("Scan text") == 1 and "Join" not in plan
