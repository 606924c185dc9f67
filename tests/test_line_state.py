"""Values that run along outputs in two levels, and the operators on them, with chunks of a few lines."""

import random

import pytest
from pyspark.sql import functions as F

from thriftline.operators import extraction, reduction, scan, sections, tools
from thriftline.operators.scan import chunked, count, earlier, largest, latest, running, since, total

ROWS = None


@pytest.fixture(scope="module")
def lines(spark):
    rng, rows = random.Random(3), []
    for o in [None, *range(12)]:
        for i in range(rng.choice([1, 5, 80])):
            rows.append((o, i, rng.choice([None, 1, 2, -3]), rng.random() < 0.2))
    return spark.createDataFrame(rows, "output_id long, line_no int, v int, r boolean").repartition(7).cache()


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_running_values_are_those_of_one_pass(lines, monkeypatch, size):
    monkeypatch.setattr(scan, "CHUNK_LINES", size)
    v, r = F.col("v"), F.col("r")
    got = running(chunked(lines), t=total(v), c=count(r), g=largest(v), l=latest(v), e=earlier(v), s=since(v, r), n=since(~r, r))
    by = {}
    for x in got.collect():
        by.setdefault(x.output_id, []).append(x)
    assert sum(map(len, by.values())) == lines.count()
    for rows in by.values():
        t = c = s = n = 0
        g = last = None
        for x in sorted(rows, key=lambda x: x.line_no):
            before = last
            t, c = t + (x.v or 0), c + x.r
            g = x.v if g is None else g if x.v is None else max(g, x.v)
            last = last if x.v is None else x.v
            s, n = (x.v or 0) + (0 if x.r else s), int(not x.r) + (0 if x.r else n)
            assert (x.t, x.c, x.g, x.l, x.e, x.s, x.n) == (t, c, g, last, before, s, n)


def texts(spark, choices, n=40, seed=4):
    rng = random.Random(seed)
    rows = [(o, "\n".join(rng.choices(choices, k=rng.choice([3, 30, 90])))) for o in range(n)] + [(None, "\n".join(rng.choices(choices, k=50)))]
    return spark.createDataFrame(rows, "output_id long, text string").repartition(3)


CASES = {
    "blocks": (["error: a", "warning: b", "  more", "\tmore", "", "", "plain", "fatal x"], lambda o: reduction.error_blocks(extraction.lines_of(o).withColumn("command", F.lit("x")))),
    "runs": (["ERROR a", "b", "c", "d"], lambda o: reduction.runs_collapsed(extraction.lines_of(o), "ERROR", 2)),
    "repeats": (["a", "b", "drop", "keep"], lambda o: reduction.without_repeats(extraction.lines_of(o), "keep", "drop")),
    "rust": (["error[E01]: x", "warning: y", "  --> a.rs:1:2", "   | z", ""], lambda o: sections.rust_blocks(extraction.lines_of(o), "cargo")),
    "pytest": (["=== FAILURES ===", "=== short test summary info ===", "FAILED a.py::b - c", "FAILED d.py::e", "x"], lambda o: sections.pytest_failures(extraction.lines_of(o))),
    "hunks": (["@@ -1 +1 @@", "diff --git a b", "--- a/x", "+++ b/x", "+a", "-b", " c", " d"], lambda o: sections.hunks_cut(extraction.lines_of(o), 2, 12)),
    "notes": (["a.py:1: error: x  [c]", "a.py:2: note: n", "b.py:3: note: m", "b.py:4:5: warning: w", "junk"], lambda o: extraction.mypy_notes(o)),
    "stat": (["+++ b/x", "--- a/x", "+a", "-b", " c", "+++ b/y"], lambda o: extraction.diff_stat(o)),
    "records": (["-[ RECORD 1 ]---", "a | 1", "b | 2", "x", "(2 rows)"], lambda o: tools.expanded_records(extraction.lines_of(o))),
    "truncate": (["fn a() {", "}", "use b;", "x", "y", "z"], lambda o: tools.smart_truncate(extraction.lines_of(o), 10)),
}


@pytest.mark.parametrize("name", CASES)
def test_operators_do_not_depend_on_chunks(spark, monkeypatch, name):
    choices, run = CASES[name]
    outputs = texts(spark, choices)
    got = {}
    for size in (1, 4, 1000):
        monkeypatch.setattr(scan, "CHUNK_LINES", size)
        got[size] = sorted(map(repr, run(outputs).collect()))
    assert got[1] == got[4] == got[1000] and got[1]


def by_hand(lines):
    """Error blocks, one line after the other."""
    out, inside, blanks = [], False, 0
    for i, line in enumerate(lines):
        if line.startswith(("error", "fatal")):
            inside, blanks = True, 0
        elif inside and line.strip(" ") == "":
            blanks += 1
            inside = blanks < 2
        elif inside:
            inside, blanks = line[:1] in " \t", 0
        if inside:
            out.append(i)
    return out


def test_error_blocks_by_hand(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_LINES", 5)
    outputs = texts(spark, ["error: a", "  more", "\tmore", "", "", "", "plain", "fatal error: x"], 30, 9)
    got = {}
    for r in reduction.error_blocks(extraction.lines_of(outputs).withColumn("command", F.lit("x"))).collect():
        got.setdefault(r.output_id, []).append(r.line_no)
    for r in outputs.collect():
        assert sorted(got.get(r.output_id, [])) == by_hand(r.text.split("\n"))


def test_one_long_output_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_LINES", 1000)
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("output_id"), F.col("id").cast("int").alias("line_no"), F.when(F.col("id") % 10 == 0, "error: x").otherwise("  y").alias("line"), F.lit("c").alias("command"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in running(chunked(rows), n=count(F.col("line").startswith("e"))).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 100_000
    assert reduction.error_blocks(rows).count() == 200_000
