"""Streaming queries over tables that are folders of part files."""

import pytest

from tests.compare import connect, differences
from thriftline import catalog

SF = "/root/testdata/sf0.001"
QUERIES = ["str_daily_rollup", "str_dedup", "str_ingest", "str_line_filter", "str_retention", "str_trailing_rollup"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """events and documents in more part files than a trigger of command_stream takes, the last days first."""
    at = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(20, "ts").write.parquet(f"{at}/ordered")
    files = sorted(spark.read.parquet(f"{at}/ordered").inputFiles(), reverse=True)
    for f in files:  # listed by time of change: the newest rows are read first
        spark.read.parquet(f).coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", QUERIES)
def test_part_files_are_read(spark, parts, name):
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{parts}/events.parquet/*.parquet')")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{parts}/documents.parquet/*.parquet')")
    assert catalog.queries()[name](spark, parts).count() > 0
    assert differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], parts) == []


def test_partitioned_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.partitionBy("event_type").parquet(f"{tmp_path}/events.parquet")
    assert catalog.queries()["str_ingest"](spark, str(tmp_path)).count() == catalog.queries()["str_ingest"](spark, SF).count() > 0
    verbs = catalog.queries()["str_dedup"](spark, str(tmp_path)).groupBy("filtered_cmd").count()
    assert sorted(verbs.collect()) == sorted(catalog.queries()["str_dedup"](spark, SF).groupBy("filtered_cmd").count().collect())
