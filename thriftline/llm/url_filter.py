"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over host + path and the literal tokens that
every match must hold as whole tokens. Each rule is indexed once, under the
one of its tokens that the fewest urls hold. A url looks up its own tokens,
and only rules fetched that way run their expression. Rules without a whole
literal token are indexed under ANY, which every url holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.llm.common import ascii_lower, repeat_rows

ANY = "*"
MAX_BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool


def host_path_rule(action: str, host: str, path: str) -> Rule:
    """Fits host, its subdomains, and paths that start with path."""
    whole = path if path.endswith("/") else path.rpartition("/")[0]  # what follows the last / may be cut short
    tokens = [t for t in re.split("[^a-z0-9]+", f"{host}/{whole}") if t]
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def pattern_rule(action: str, regex: str, *tokens: str) -> Rule:
    """A rule of the method's own; tokens must stand whole in every match."""
    return Rule(regex, action, regex, tokens, False)


#: Listed rules, and patterns for what they leave open.
LISTED = (
    host_path_rule("allow", "com", "/"),
    host_path_rule("block", "example.com", "/en/"),
    host_path_rule("allow", "www.example.com", "/en/"),
    host_path_rule("block", "net", "/es/"),
    host_path_rule("block", "net", "/fr/"),
)
PATTERNS = (
    pattern_rule("block", r"(?:^|\.)spam-farm\.", "spam", "farm"),
    pattern_rule("block", r"(?:^|\.)cheap-pills\.", "cheap", "pills"),
    pattern_rule("block", r"(?:^|[.-])casino[.-]", "casino"),
    pattern_rule("block", r"/(?:ads|adserver)(?:/|$)"),
)


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"), F.array(*[F.lit(t) for t in r.tokens or (ANY,)]).alias("tokens"), F.lit(r.listed).alias("listed"))
        for i, r in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_tokens(host_path: Column) -> Column:
    """Distinct tokens of a url, always with ANY."""
    found = F.filter(F.split(ascii_lower(host_path), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_union(F.array(F.lit(ANY)), F.array_distinct(found))


def index_rules(urls: DataFrame, rules: DataFrame, bounded: bool) -> DataFrame:
    """rules with `token`: of a rule's tokens the one that the fewest rows of urls (host_path) hold; ties by token."""
    small = F.broadcast if bounded else lambda df: df
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode(url_tokens(F.col("host_path"))).alias("token")).join(small(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    best = rules.select("rule_no", F.explode("tokens").alias("token")).join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.join(best, "rule_no").select("rule_no", "name", "action", "regex", "listed", F.col("best.token").alias("token"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict, pattern), one row per row of pages.

    The longest listed rule that fits gives rule and verdict (ties: the
    smaller name). Where none fits, rule is null and the patterns decide: a
    fitting allow pattern, else a fitting block pattern, else allow; pattern
    names the one that decided. A null url, or one without ://, has empty host
    and path and is allowed unless a pattern fits the empty string. Repeated
    rows are judged once and returned as often as they come. Other columns of
    pages are not read. An empty table gives no rows.
    """
    spark, bounded = pages.sparkSession, len(rules) <= MAX_BROADCAST_RULES
    small = F.broadcast if bounded else lambda df: df
    has = F.instr("url", "://") > 0
    urls = (
        pages.groupBy(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .agg(F.count("*").alias("copies"))
        .withColumn("host", F.when(has, host_of(F.col("url"))).otherwise(""))
        .withColumn("path", F.when(has, path_of(F.col("url"))).otherwise(""))
        .withColumn("host_path", F.concat("host", "path"))
    )
    index = index_rules(urls, rule_table(spark, rules), bounded)
    tried = urls.withColumn("token", F.explode(url_tokens(F.col("host_path")))).join(small(index), "token", "left")
    fits = F.col("name").isNotNull() & F.expr("host_path rlike regex")
    # a negated code point order is not at hand: the smaller name wins through min of (-length, name)
    listed = F.min(F.when(fits & F.col("listed"), F.struct(-F.length("name"), "name", "action")))
    pattern = F.min(F.when(fits & ~F.col("listed"), F.struct("action", "rule_no", "name")))  # allow sorts before block
    judged = tried.groupBy("page_id", "url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"), listed.alias("l"), pattern.alias("p"))
    judged = judged.select(
        "page_id", "host", "path", F.col("l.name").alias("rule"),
        F.coalesce("l.action", "p.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("l").isNull(), F.col("p.name")).alias("pattern"), "copies",
    )
    return repeat_rows(judged, "copies")


#: op10 for DuckDB, by trying every rule on every url.
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    CASE WHEN regexp_matches(host || path, '(?:^|\.)spam-farm\.') THEN '(?:^|\.)spam-farm\.'
    WHEN regexp_matches(host || path, '(?:^|\.)cheap-pills\.') THEN '(?:^|\.)cheap-pills\.'
    WHEN regexp_matches(host || path, '(?:^|[.-])casino[.-]') THEN '(?:^|[.-])casino[.-]'
    WHEN regexp_matches(host || path, '/(?:ads|adserver)(?:/|$)') THEN '/(?:ads|adserver)(?:/|$)' END AS hit FROM s
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern FROM r
"""
