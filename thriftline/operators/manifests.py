"""Dependencies that manifests declare: (output_id, kind, section, name, version) from lines (output_id, kind, line_no, line) or texts.

cargo, pyproject and gomod carry a section or a block from line to line;
requirements are read line by line; package_json is one JSON text.

A text is cut where its sections and blocks begin and end, in its row: nothing
is shuffled or sorted, and a task holds one text at a time. Manifests that are
too long for one value come as lines, along which scan.py carries the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.functions.text import stripped
from thriftline.operators.scan import chunked, count, largest, latest, running

#: How sections and dependencies are written.
CARGO_SECTION = r"^\[([^\]]+)\]"
CARGO_DEPENDENCY = r'^([a-zA-Z0-9_-]+)\s*=\s*(?:"([^"]+)"|.*version\s*=\s*"([^"]+)")'
REQUIREMENT = r"^([a-zA-Z0-9_-]+)([=<>!~]+.*)?$"
#: The same in a whole text, of which only \n ends a line: where sections begin, a line that opens or closes a list or a block.
BLANKS = r"[ \t\x0b\x0c\r]*"
CARGO_SPAN = r"(?md)^(?=\[[^\]\n]+\])"
LIST_OPENS = r"(?md)^(?=[^\n]*dependencies)(?=[^\n]*\[)[^\n]*(?:\n|\z)"
LIST_CLOSES = rf"(?md)^{BLANKS}\]{BLANKS}$"
BLOCK_SPAN = rf"(?md)^(?={BLANKS}(?:require \(|\)){BLANKS}$)"
KINDS = ("cargo", "package_json", "requirements", "pyproject", "gomod")
FIELDS = ("output_id", "kind", "section", "name", "version")


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def _told(rows: DataFrame, kind: str, section: Column, name: Column, version: Column) -> DataFrame:
    return rows.select("output_id", F.lit(kind).alias("kind"), section.alias("section"), name.alias("name"), version.alias("version"))


def _cargo(rows: DataFrame) -> DataFrame:
    """Of lines and the sections that they are in."""
    line = F.col("line")
    rows = rows.filter(F.col("section").isin("dependencies", "dev-dependencies") & ~line.rlike(CARGO_SECTION) & line.rlike(CARGO_DEPENDENCY))
    return _told(rows, "cargo", F.col("section"), _group(line, CARGO_DEPENDENCY, 1), F.coalesce(_group(line, CARGO_DEPENDENCY, 2), _group(line, CARGO_DEPENDENCY, 3), F.lit("*")))


def cargo(lines: DataFrame) -> DataFrame:
    """name = "version", or a table with a version, below [dependencies] and [dev-dependencies]."""
    return _cargo(running(chunked(lines), section=latest(_group(F.col("line"), CARGO_SECTION, 1))))


def cargo_texts(texts: DataFrame) -> DataFrame:
    """cargo of texts (output_id, text)."""
    spans = texts.select("output_id", F.explode(F.split("text", CARGO_SPAN)).alias("span"))
    return _cargo(spans.select("output_id", _group(F.col("span"), CARGO_SECTION, 1).alias("section"), F.explode(F.split("span", "\n")).alias("line")))


def requirements(lines: DataFrame) -> DataFrame:
    """A name with what it requires of the version, if anything; comments and blank lines go."""
    line = stripped("line")
    rows = lines.filter(~line.startswith("#") & line.rlike(REQUIREMENT))
    return _told(rows, "requirements", F.lit("packages"), _group(line, REQUIREMENT, 1), F.regexp_extract(line, REQUIREMENT, 2))


def requirements_texts(texts: DataFrame) -> DataFrame:
    """requirements of texts (output_id, text)."""
    return requirements(texts.select("output_id", F.explode(F.split("text", "\n")).alias("line")))


def _opens() -> Column:
    return F.col("line").contains("dependencies") & F.col("line").contains("[")


def _pyproject(rows: DataFrame) -> DataFrame:
    """Of the lines inside a list."""
    rows = rows.withColumn("item", F.btrim(stripped("line"), F.lit("\"',"))).filter("item <> ''")
    name = r"^([A-Za-z0-9._-]+(?:\[[^\]]*\])?)\s*(.*)$"
    return _told(rows, "pyproject", F.lit("dependencies"), F.coalesce(_group(F.col("item"), name, 1), F.col("item")), F.regexp_extract("item", name, 2))


def pyproject(lines: DataFrame) -> DataFrame:
    """The items of the first list of dependencies, to its closing line; version is what follows the name."""
    rows = running(chunked(lines.withColumn("opens", _opens())), opened=count(F.col("opens")))
    rows = running(rows, closed=count((F.col("opened") > 0) & ~F.col("opens") & (stripped("line") == "]")))
    return _pyproject(rows.filter((F.col("opened") > 0) & ~F.col("opens") & (F.col("closed") == 0)))


def pyproject_texts(texts: DataFrame) -> DataFrame:
    """pyproject of texts (output_id, text)."""
    below = F.get(F.split("text", LIST_OPENS, 2), F.lit(1))
    inside = F.get(F.split(below, LIST_CLOSES, 2), F.lit(0))
    return _pyproject(texts.select("output_id", F.explode(F.split(inside, "\n")).alias("line")).filter(~_opens()))


def _may_require(said: Column) -> Column:
    """Lines that may be or enclose requirements."""
    return ~said.startswith("module ") & ~said.startswith("go ")


def _gomod(rows: DataFrame) -> DataFrame:
    """Of lines, said without blanks at their ends, and whether they are inside a block."""
    words = F.filter(F.split("said", r"\s+"), lambda w: w != "")
    rows = rows.filter(~F.col("said").isin("require (", ")")).withColumn("inside", F.col("inside") & ~F.col("said").startswith("//")).withColumn("w", words)
    listed = F.col("inside") & (F.size("w") >= 2)
    alone = ~F.col("inside") & F.col("said").startswith("require ") & ~F.col("said").contains("(")
    name, version = F.when(listed, F.get("w", F.lit(0))).otherwise(F.get("w", F.lit(1))), F.when(listed, F.get("w", F.lit(1))).otherwise(F.coalesce(F.get("w", F.lit(2)), F.lit("")))
    return _told(rows.filter(listed | alone), "gomod", F.lit("require"), name, version)


def gomod(lines: DataFrame) -> DataFrame:
    """Modules of require blocks and of single require lines."""
    rows = lines.withColumn("said", stripped("line")).filter(_may_require(F.col("said")))
    at = lambda flag: largest(F.when(flag, F.col("line_no")))
    rows = running(chunked(rows), opened=at(F.col("said") == "require ("), closed=at(F.col("said") == ")"))
    return _gomod(rows.withColumn("inside", F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("closed") < F.col("opened")))))


def gomod_texts(texts: DataFrame) -> DataFrame:
    """gomod of texts (output_id, text)."""
    spans = texts.select("output_id", F.explode(F.split("text", BLOCK_SPAN)).alias("span"))
    lines = spans.select("output_id", (stripped(F.substring_index("span", "\n", 1)) == "require (").alias("inside"), F.explode(F.split("span", "\n")).alias("line"))
    return _gomod(lines.withColumn("said", stripped("line")).filter(_may_require(F.col("said"))))


def package_json(outputs: DataFrame) -> DataFrame:
    """dependencies and devDependencies of JSON manifests (output_id, text); a version that is no string is *. Other texts give no rows."""
    v = F.try_parse_json("text")
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.try_variant_get(v, f"$.{s}", "map<string,variant>").alias("m")) for s in ("dependencies", "devDependencies")])
    rows = outputs.select("output_id", F.inline(sections)).select("output_id", "section", F.explode("m").alias("name", "v"))
    is_text = F.schema_of_variant("v") == "STRING"
    return _told(rows, "package_json", F.col("section"), F.col("name"), F.when(is_text, F.try_variant_get("v", "$", "string")).otherwise("*"))


def dependencies(manifests: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Of manifests (output_id, kind, text), by kind; other kinds give no rows. Where lines (output_id, kind, line_no, line) are given, all but JSON is read from them."""
    of = lambda df, kind: df.filter(F.col("kind") == kind).drop("kind")
    out = package_json(of(manifests, "package_json"))
    of_lines = {"cargo": cargo, "requirements": requirements, "pyproject": pyproject, "gomod": gomod}
    of_texts = {"cargo": cargo_texts, "requirements": requirements_texts, "pyproject": pyproject_texts, "gomod": gomod_texts}
    for kind, read in (of_texts if lines is None else of_lines).items():
        out = out.unionByName(read(of(manifests if lines is None else lines, kind)))
    return out
