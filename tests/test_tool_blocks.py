"""Tool outputs in several texts: none grows with a user's share of the events, and the results are those of one text."""

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from thriftline import catalog
from thriftline.operators import extraction
from thriftline.sources import derived as d

SF = "/root/testdata/sf0.001"
QUERIES = """
ext_eslint ext_golangci ext_mypy ext_go_test ext_pip_list ext_cargo_build ext_cargo_test ext_pytest ext_psql_table ext_manifest_deps
win_attach_notes win_section_state win_hunk_budget agg_diff_stat agg_change_counts agg_pods agg_lint_rules join_build_errors join_failed_test_output
""".split()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BITS", 5)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The events with one user for half of them."""
    at = str(tmp_path_factory.mktemp("skewed"))
    user = F.when(F.col("event_id") % 2 == 0, F.lit(1)).otherwise(F.col("user_id"))
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("user_id", user.cast(e.schema["user_id"].dataType)).write.parquet(f"{at}/events.parquet")
    return at


def test_texts_are_bounded(spark, skewed, small):
    texts = d.tool_text(spark, skewed, F.col("message"))
    assert texts.select(F.max(F.size(F.split("text", "\n")))).first()[0] <= 2**5 + 1
    arrays = d.tool_json(spark, skewed, F.struct("message")).select(F.size(F.from_json("text", "array<struct<message:string>>")).alias("n"))
    assert arrays.agg(F.max("n"), F.sum("n")).first() == (arrays.agg(F.max("n")).first()[0], 1000) and arrays.agg(F.max("n")).first()[0] <= 2**5


def test_lines_are_numbered_through(spark, skewed, small):
    rows = extraction.lines_of(d.tool_text(spark, skewed, F.concat(F.lit("x\n"), F.col("n")))).filter("output_id = 1").orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(len(rows))) and len(rows) >= 1000
    ids = [int(r.line) for r in rows[1::2]]
    assert ids == sorted(ids) and {r.line for r in rows[::2]} == {"x"}


@pytest.mark.parametrize("name", QUERIES)
def test_several_texts_give_the_same(spark, skewed, small, name):
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{skewed}/events.parquet/*.parquet')")
    assert differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name].replace(">> 14", ">> 5"), skewed) == []
