"""The query of code outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.operators import outline as op
from thriftline.plans.registry import query
from thriftline.sources import derived as d

lit, col = F.lit, F.col

EXTS = ("rs", "js", "ts", "go", "c", "cpp", "java", "py", "rb", "sh")
LICENCE = ("Copyright", "All rights reserved", "Licensed under", "See LICENSE", "for details")


def snippet(mark: Column, slashes: Column) -> Column:
    """What an event adds to its user's source file."""
    n, k = col("n"), col("n") % 8
    body = F.concat(lit("fn f"), n, lit("() {\n  if x {\n"), F.repeat(lit("    y = 1;\n"), (n % 45).cast("int")), lit("  }\n}"))
    return (
        F.when(k == 0, F.concat(lit("import m"), n)).when(k == 1, F.concat(mark, lit(" ======"))).when(k == 2, F.concat(mark, lit(" note "), n))
        .when(k == 3, F.when(slashes, F.concat(lit("/* long\n   text "), n, lit(" */"))).otherwise(F.concat(mark, lit(" text "), n)))
        .when(k == 4, F.when(slashes, lit("/* ---- */")).otherwise(F.concat(mark, lit(" Code generated")))).when(k == 5, body)
        .when(k == 6, F.concat(lit("let s"), n, lit(' = "/* no comment";'))).otherwise(F.concat(lit("x"), n, lit(' = "'), mark, lit(' in a string"')))
    )


@query(f"""WITH e AS (
  SELECT output_id, n, n >> {d.BLOCK_BITS} AS part, n % 8 AS k, {list(EXTS)}[output_id % {len(EXTS)} + 1] AS ext, CASE WHEN output_id % {len(EXTS)} < 7 THEN '//' ELSE '#' END AS mark FROM tool_rows_v
), p AS (
  SELECT *, '  if x {{' || chr(10) || repeat('    y = 1;' || chr(10), (n % 45)::INT) || '  }}' AS body,
    CASE k WHEN 0 THEN 'import m' || n WHEN 2 THEN mark || ' note ' || n WHEN 3 THEN CASE mark WHEN '#' THEN '# text ' || n ELSE '/* long' || chr(10) || '   text ' || n || ' */' END
      WHEN 5 THEN 'fn f' || n || '() {{' || chr(10) || body || chr(10) || '}}' WHEN 6 THEN 'let s' || n || ' = "/* no comment";' WHEN 7 THEN 'x' || n || ' = "' || mark || ' in a string"' END AS minimal,
    CASE k WHEN 0 THEN minimal WHEN 5 THEN 'fn f' || n || '() {{' || chr(10) || CASE WHEN n % 45 + 2 <= 30 THEN body ELSE '    // ... (' || (n % 45 + 2) || ' lines)' END WHEN 6 THEN minimal END AS aggressive,
    CASE k WHEN 3 THEN CASE mark WHEN '#' THEN 1 ELSE 2 END WHEN 5 THEN n % 45 + 4 ELSE 1 END AS size
  FROM e
), f AS (
  SELECT output_id, ext, 7 + sum(size) AS lines, 'package p' || coalesce(chr(10) || string_agg(minimal, chr(10) ORDER BY n), '') AS minimal, coalesce(string_agg(aggressive, chr(10) ORDER BY n), '') AS aggressive FROM p GROUP BY output_id, part, ext
), o AS (SELECT output_id, ext, lines, unnest([{{'level': 'minimal', 'outline': minimal}}, {{'level': 'aggressive', 'outline': aggressive}}]) AS x FROM f)
SELECT output_id, ext, x.level AS level, lines::BIGINT AS lines, CASE WHEN x.outline = '' THEN 0 ELSE length(x.outline) - length(replace(x.outline, chr(10), '')) + 1 END::BIGINT AS kept_lines, md5(x.outline) AS outline_md5 FROM o""")
def win_code_outline(spark: SparkSession, sf: str) -> DataFrame:
    """A source file per user, in ten languages, with a licence on top and comment marks in strings; both levels."""
    which = (col("output_id") % len(EXTS)).cast("int")
    slashes = which < 7
    mark = F.when(slashes, "//").otherwise("#")
    texts = d.tool_text(spark, sf, snippet(mark, slashes), numbered=False)
    licence = F.array_join(F.array(*[F.concat(mark, lit(f" {line}")) for line in LICENCE]), "\n")
    files = texts.select("output_id", F.element_at(F.array(*[lit(e) for e in EXTS]), which + 1).alias("ext"), F.concat(licence, lit("\n\npackage p\n"), "text").alias("text"))
    both = None
    for level in ("minimal", "aggressive"):
        cut = op.code_outline(files, level).select("output_id", "ext", lit(level).alias("level"), "lines", "kept_lines", F.md5("outline").alias("outline_md5"))
        both = cut if both is None else both.unionByName(cut)
    return both
