"""Trees of unknown depth in JSON texts: walked level by level, each level by all tasks, until one has no nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions.text import stripped
from thriftline.session import shared_path
from thriftline.sources.sessions import text_at


def walked(roots: DataFrame, children: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """roots and all nodes below them. children gives the nodes right below those of a level, in the columns of roots.

    A level is written to the shared folder before the next one is asked for,
    so that plans stay small however deep the trees are; there is no limit.
    """
    spark, at, depth = roots.sparkSession, shared_path(roots.sparkSession, "levels"), 0
    level = roots
    while True:
        path = f"{at}/level={depth}"
        level.write.parquet(path)
        level = spark.read.schema(roots.schema).parquet(path)
        if level.isEmpty():
            return spark.read.schema(roots.schema).option("recursiveFileLookup", "true").parquet(at)
        level, depth = children(level), depth + 1


def entries(v: Column | str, path: str) -> Column:
    """Names and values (variants) of an object at a path of a variant; null where there is none."""
    return F.try_variant_get(v, path, "map<string,variant>")


def texts_of(outputs: DataFrame) -> DataFrame:
    """(key, text): the distinct texts of outputs (output_id, text), told apart from those of other outputs by key."""
    return outputs.select(text_key().alias("key"), "text").filter("text is not null").dropDuplicates(["key"])


def text_key() -> Column:
    return F.struct("output_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))


def _objects(values: Column) -> Column:
    return F.forall(values, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


#: What lines of drawn tables and of legends hold.
BOX_MARKS, OUTDATED_MARKS = "[│├└]", "[│├└─]"


def _lines(outputs: DataFrame, noise: Column) -> DataFrame:
    rows = outputs.select("output_id", F.explode(F.split("text", r"\r?\n")).alias("line"))
    return rows.filter((stripped("line") != "") & ~noise).withColumn("w", F.filter(F.split("line", r"\s+"), lambda x: x != ""))


def pnpm_packages(outputs: DataFrame) -> DataFrame:
    """(output_id, name, version, dev, parse_tier): the packages of dependency listings (output_id, text), each as often as the tree holds it.

    Rows of outputs are walked as they come, so nothing is shuffled or joined.
    Tier 1 is a JSON map of packages by name, with packages below packages; what
    is below a development dependency is one too. Packages without a version
    give no row, those below them do. Other texts are tier 2: name@version at
    the start of a line. What has neither, and null, gives no rows.
    """
    rows = outputs.withColumn("top", entries(F.try_parse_json("text"), "$"))
    whole = F.coalesce(F.col("top").isNotNull() & _objects(F.map_values("top")), F.lit(False))
    roots = rows.filter(whole).select("output_id", F.explode("top").alias("name", "v"), F.lit(False).alias("dev"))

    def below(level: DataFrame) -> DataFrame:
        kinds = F.array(F.struct(F.col("dev").alias("dev"), entries("v", "$.dependencies").alias("m")), F.struct(F.lit(True).alias("dev"), entries("v", "$.devDependencies").alias("m")))
        found = level.select("output_id", F.explode(kinds).alias("k")).filter("k.m is not null")
        return found.select("output_id", F.explode("k.m").alias("name", "v"), F.col("k.dev").alias("dev"))

    per = walked(roots, below).select("output_id", "name", text_at(F.col("v"), "$.version").alias("version"), "dev", F.lit(1).alias("parse_tier")).filter("version is not null")
    lines = _lines(rows.filter(~whole), F.col("line").rlike(BOX_MARKS) | F.col("line").contains("Legend:"))
    said = r"^(.+)@([^@]+)$"
    first = F.get("w", F.lit(0))
    text = lines.filter(first.rlike(said)).select("output_id", F.regexp_extract(first, said, 1).alias("name"), F.regexp_extract(first, said, 2).alias("version"), F.lit(False).alias("dev"), F.lit(2).alias("parse_tier"))
    return per.unionByName(text)


def pnpm_outdated(outputs: DataFrame) -> DataFrame:
    """(output_id, name, current, latest, wanted, dev, parse_tier) of reports of outdated packages (output_id, text).

    Tier 1 is a JSON map by name in which every package has a current and a
    latest version. Other texts are tier 2: name, current, wanted and latest
    as the first four words of a line, without headers and drawn lines.
    """
    package = "map<string,struct<current:string,latest:string,wanted:string,dependencyType:string>>"
    rows = outputs.withColumn("m", F.from_json("text", package))
    whole = F.coalesce(F.col("m").isNotNull() & F.forall(F.map_values("m"), lambda x: x["current"].isNotNull() & x["latest"].isNotNull()), F.lit(False))
    rows = rows.withColumn("whole", whole)
    full = rows.filter("whole").select("output_id", F.explode("m").alias("name", "v"))
    full = full.select("output_id", "name", "v.current", "v.latest", "v.wanted", F.coalesce(F.col("v.dependencyType") == "devDependencies", F.lit(False)).alias("dev"), F.lit(1).alias("parse_tier"))
    lines = _lines(rows.filter("not whole"), F.col("line").rlike(OUTDATED_MARKS) | F.col("line").startswith("Legend:") | F.col("line").startswith("Package")).filter(F.size("w") >= 4)
    word = lambda i: F.get("w", F.lit(i))
    return full.unionByName(lines.select("output_id", word(0).alias("name"), word(1).alias("current"), word(3).alias("latest"), word(2).alias("wanted"), F.lit(False).alias("dev"), F.lit(2).alias("parse_tier")))


TESTS = "array<struct<status:string,results:array<struct<status:string,errors:array<struct<message:string>>>>>>"


def suite_specs(outputs: DataFrame) -> DataFrame:
    """(key, total, failures, passed_names) of test reports of suites in suites: a suite's own specs before those of the suites in it.

    failures holds (test, file, error); the error is that of the first failed
    or timed out run of the first unexpected test. key is text_key().
    """
    texts = texts_of(outputs).withColumn("v", F.try_parse_json("text"))
    listed = lambda v, path: F.posexplode(F.try_variant_get(v, path, "array<variant>")).alias("i", "s")
    roots = texts.select("key", listed("v", "$.suites")).select("key", F.array("i").alias("place"), "s")
    every = walked(roots, lambda level: level.select("key", "place", listed("s", "$.suites")).select("key", F.concat("place", F.array("i")).alias("place"), "s"))
    specs = every.select("key", "place", F.coalesce(text_at(F.col("s"), "$.file"), text_at(F.col("s"), "$.title")).alias("file"), F.posexplode(F.try_variant_get("s", "$.specs", "array<variant>")).alias("i", "p"))
    tests = F.try_variant_get("p", "$.tests", TESTS)
    specs = specs.select("key", "place", "i", "file", text_at(F.col("p"), "$.title").alias("test"), F.coalesce(F.try_variant_get("p", "$.ok", "boolean"), F.lit(False)).alias("ok"), tests.alias("tests"))
    unexpected = F.get(F.filter("tests", lambda t: t["status"] == "unexpected"), F.lit(0))
    run = F.get(F.filter(unexpected["results"], lambda r: r["status"].isin("failed", "timedOut")), F.lit(0))
    error = F.coalesce(F.get(run["errors"], F.lit(0))["message"], F.lit("Test failed"))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["x"])
    at = [F.col("place"), F.col("i")]
    return specs.groupBy("key").agg(
        F.count("*").alias("total"), in_order(F.when(~F.col("ok"), F.struct(*at, F.struct("test", "file", error.alias("error")).alias("x")))).alias("failures"), in_order(F.when(F.col("ok"), F.struct(*at, F.col("test").alias("x")))).alias("passed_names"),
    )
