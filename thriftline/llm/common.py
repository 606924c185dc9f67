"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY_BITS = 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else, whatever the locale."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="thriftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str, settings: dict[str, str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage: a lost executor makes Spark reread the files, not
    recompute what made them. Files belong to this application's folder and
    can be removed once its results are written; see stashes_of. settings hold
    for the session while df is written; options are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/thriftline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with settings_of(spark, settings or {}):
        df.write.options(**(options or {})).parquet(path)
    for paths in _recording:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings_of(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as the block runs."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For tables of few, very large values: a row group for each when written; when they meet, one at a time is read and sent to Python.
LARGE = {"parquet.block.size": str(1 << 20), "parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
MEETING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.enableVectorizedReader": "false"}


def meet(index: DataFrame, blocks: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """What a task's search gives for each part of index (no, index) and each block of queries (block), all pickled.

    make() begins a task: it returns a function of a part and a block, which
    gives a record batch or None, and one that gives the last one.

    Every part of an index has to see a stated set of queries, so this is the
    one product of two tables here: of few, large rows, the parts of an index
    and the blocks of queries. Spark reads both from their files (stashed with
    LARGE): the smaller one is broadcast if it is below Spark's own limit, else
    tasks pair up partitions; nothing is shuffled. To be run by stash with
    MEETING, which keeps few of the values in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (call, finish), no, part = make(), None, None
        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != no:
                    part = None  # one part at a time
                    no, part = b.column(0)[i].as_py(), pickle.loads(b.column(1)[i].as_buffer())
                made = call(part, pickle.loads(b.column(2)[i].as_buffer()))
                if made is not None:
                    yield made
        made = finish()
        if made is not None:
            yield made

    return index.select("no", "index").crossJoin(blocks.select("block")).mapInArrow(run, schema)


def join_heavy(rows: DataFrame, dim: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", most: int = 4096) -> DataFrame:
    """rows joined with dim (one row per key) on keys of which a few may hold any share of the rows.

    weight is a column of dim: how many of total rows a key has, or more.
    Keys with over 1/most of the total are heavy. There are at most `most`, so
    they are broadcast; the others are shuffled. dim and rows are read twice.
    """
    is_heavy = F.col(weight) * most >= F.lit(max(1, total))
    heavy = F.broadcast(dim.filter(is_heavy))
    light = rows.join(F.broadcast(dim.filter(is_heavy).select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(light.join(dim.filter(~is_heavy), on, how))


def shielded(docs: DataFrame, needed: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run on docs, whose columns but the needed have other names meanwhile, so that none clashes with those that run makes.

    A column that run makes under the name of one of docs' is dropped.
    """
    hidden = {c: f"_hidden{i}" for i, c in enumerate(docs.columns) if c not in needed}
    made = run(docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]))
    new = [c for c in made.columns if c not in {*hidden.values(), *docs.columns}]
    return made.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns], *new)


_recording: list[list[str]] = []


@contextmanager
def stashes_of() -> Iterator[list[str]]:
    """The paths that stash writes in this block, for drop_paths once nothing reads them any more."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.remove(paths)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Spark's file system, wherever they are, and forget them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def unit_key(*cols: Column) -> Column:
    """A uniform key in [0, 2^62) from the hash of cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - KEY_BITS)


def n_rank_buckets(n_rows: int, rows_per_bucket: int = 50_000) -> int:
    return max(256, -(-n_rows // rows_per_bucket))


def gapless_rank(df: DataFrame, group: list[str], key: str, ties: list[str], out: str, n_buckets: int) -> DataFrame:
    """Add out: the rank from 0 within group, by key (uniform in [0, 2^62)) and ties.

    No task sees a whole group: rows are ranked inside (group, key range), and
    ranges get offsets from the running sum of their counts, so a group may
    hold any share of the rows. df is read twice.
    """
    width = (1 << KEY_BITS) // n_buckets + 1
    df = df.withColumn("_b", F.floor(F.col(key) / F.lit(width)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*group, "_b").agg(F.count("*").alias("_n")).select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_b"]]
    inside = Window.partitionBy(*[F.col(f"a.{c}") for c in [*group, "_b"]]).orderBy(F.col(f"a.{key}"), *[F.col(f"a.{c}") for c in ties])
    joined = df.alias("a").join(starts.alias("s"), on, "left")
    return joined.select("a.*", (F.col("s._start") + F.row_number().over(inside) - 1).cast("long").alias(out)).drop("_b")


def repeat_rows(df: DataFrame, n: str, step: int = 1000) -> DataFrame:
    """Each row n times, by two bounded arrays instead of one of length n; drops n."""
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col(n) - 1) / step).cast("long"))))
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(1), F.least(F.lit(step), F.col(n) - F.col("_i") * step).cast("int"))))
    return df.drop(n, "_i", "_j")
