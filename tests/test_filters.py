"""Registered filters and parsers: what they raise leaves a text raw."""

import pytest
from pyspark.sql import functions as F

from thriftline.operators import filters as op


def outputs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "output_id long, command string, text string")


def test_filters_that_fail_leave_texts_raw(spark):
    made = op.Filters().register("a", "^a", lambda t: t[: 5 // (len(t) % 7)]).register("b", "^b", lambda t: (t.upper(), op.DEGRADED)).register("c", "^c", lambda t: 5).register("d", "^d", lambda t: None).register("ab", "ab", lambda t: "never first", strips_ansi=True)
    rows = [("a x", "y" * k) for k in range(15)] + [("b", "text"), ("c", "text"), ("d", "text"), ("other", "text"), ("a", None), (None, "text"), ("xab", "\x1b[1mq")]
    got = made.apply(outputs(spark, *rows)).orderBy("output_id").collect()
    for k in range(15):
        r = got[k]
        assert (r.result.quality, r.result.output, r.error is None) == ((op.PASSTHROUGH, "y" * k, False) if k % 7 == 0 else (op.FULL, ("y" * k)[: 5 // (k % 7)], True))
    assert [(r.tool, r.result.output, r.result.quality) for r in got[15:]] == [("b", "TEXT", "degraded"), ("c", "text", "passthrough"), ("d", "text", "passthrough"), (None, "text", "passthrough"), ("a", None, "passthrough"), (None, "text", "passthrough"), ("ab", "never first", "full")]
    assert got[16].error.startswith("TypeError") and got[17].error is None and got[21].result.input_tokens == 1
    assert {r.tool: r.failed for r in op.filter_report(made.apply(outputs(spark, *rows))).collect()}["a"] == 3
    assert made.apply(outputs(spark, ("a", "b")).limit(0)).count() == 0
    with pytest.raises(ValueError, match="is registered"):
        made.register("a", "x", str)


def test_results_that_are_not_worth_it_are_raw(spark):
    text = "word " * 400
    made = op.Filters().register("none", "^none", lambda t: " \n").register("little", "^little", lambda t: t[: int(len(t) * 0.85)]).register("some", "^some", lambda t: (t[: int(len(t) * 0.7)], op.DEGRADED)).register("good", "^good", lambda t: t[: len(t) // 2]).register("most", "^most", lambda t: t[:40])
    rows = op.validated(made.apply(outputs(spark, *[(c, text) for c in ("none", "little", "some", "good", "most")], ("most", "line\n" * 300), ("good", ""), ("good", None)))).orderBy("output_id").collect()
    assert [r.result.quality for r in rows] == ["passthrough", "passthrough", "passthrough", "full", "passthrough", "full", "full", "passthrough"]
    assert all(r.result.output == text for r in rows[:3])


def test_filters_are_a_sql_function(spark):
    op.Filters().register("short", ".", lambda t: t[:2]).register_sql(spark, "shortened")
    assert spark.sql("SELECT shortened('short', 'abc').output AS output, shortened('other', 'abc').error AS e").first()["output"] == "ab"


def test_parsers_by_kind(spark):
    rows = outputs(spark, ("one x", "a"), ("two", "b"), ("three", "c"))
    parsers = {"p": op.Parser("k", "^one", lambda d: d), "q": op.Parser("k", "^two", lambda d: d.withColumnRenamed("text", "said")), "r": op.Parser("other", ".", lambda d: d)}
    assert sorted((r.output_id, r.parser, r.text, r.said) for r in op.parsed(rows, parsers, "k").collect()) == [(0, "p", "a", None), (1, "q", None, "b")]
    with pytest.raises(ValueError, match="no parser"):
        op.parsed(rows, parsers, "missing")


def test_texts_that_no_filter_takes_stay_out_of_python(spark):
    made = op.Filters().register("short", "^short", lambda t: t[:2])
    rows = spark.range(200).select(F.col("id").alias("output_id"), F.when(F.col("id") % 50 == 0, "short").when(F.col("id") % 50 > 1, "long").alias("command"), F.repeat(F.lit("x"), F.when(F.col("id") % 50 == 0, 5).otherwise(10_000).cast("int")).alias("text"))
    made = made.apply(rows)
    got = {(r.tool, r.result.output, r.result.quality, r.result.input_tokens, r.result.output_tokens, r.error) for r in made.collect()}
    assert got == {("short", "xx", op.FULL, 2, 1, None), (None, "x" * 10_000, op.PASSTHROUGH, 2500, 2500, None)}
    assert sent(made._jdf.queryExecution().executedPlan()) < 50_000


def sent(plan) -> int:
    """Bytes that a plan's steps have sent to Python workers."""
    said = plan.metrics().get("pythonDataSent")
    children = plan.children()
    return (said.get().value() if said.isDefined() else 0) + sum(sent(children.apply(i)) for i in range(children.size()))
