"""Inputs of the engine derived from the given tables, in Spark and, for comparison, in DuckDB SQL.

The given tables hold no telemetry or session logs; these rules make some from
`events`, so that every query's work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thriftline.functions.numbers import saved_tokens, share_pct
from thriftline.functions.text import text_lines
from thriftline.plans.registry import view

#: The moment that trailing windows end at.
AS_OF = "2024-04-01 00:00:00"
VERBS = {"view": "git status", "click": "cargo test", "purchase": "npm run build", "signup": "grep -rn"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table of executed commands."""
    return commands_of(read(spark, sf_dir, "events"))


def commands_of(e: DataFrame) -> DataFrame:
    """Command facts of events, which may be a stream."""
    verb = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in VERBS.items()], F.lit("ls -la"))
    tokens = F.floor(F.abs("value") * 100).cast("long")
    user, event = F.col("user_id"), F.col("event_id")
    path = F.when(user % 12 == 11, "").when(user % 12 != 10, F.concat(F.lit("/w/p"), user % 12, F.when(event % 5 == 0, "/sub").otherwise("")))
    e = e.select(
        event.alias("id"), (F.col("ts").cast("timestamp") + F.make_ym_interval(F.lit(0), (user % 3).cast("int"))).alias("ts"),
        F.concat_ws(" ", verb, event % 7).alias("original_cmd"), verb.alias("filtered_cmd"),
        tokens.alias("input_tokens"), F.floor(tokens * (event % 11) / 10).cast("long").alias("output_tokens"),
        (event % 500).alias("exec_time_ms"), path.alias("project_path"),
        F.when(event % 4 == 0, "").when(event % 4 != 1, F.concat(F.lit("name"), event % 3)).alias("project_name"),
        user.cast("string").alias("session_id"), (event % 4).cast("int").alias("parse_tier"),
        F.when(event % 9 == 0, "passthrough").otherwise("filtered").alias("execution_kind"),
    )
    e = e.withColumn("saved_tokens", saved_tokens(F.col("input_tokens"), F.col("output_tokens")))
    return e.withColumn("savings_pct", share_pct(F.col("saved_tokens"), F.col("input_tokens")))


view("commands_v", """
SELECT *, CASE WHEN input_tokens > 0 THEN saved_tokens * 100.0::DOUBLE / input_tokens ELSE 0 END AS savings_pct FROM (
SELECT *, greatest(input_tokens - output_tokens, 0) AS saved_tokens FROM (
SELECT *, CAST(floor(input_tokens * (id % 11) / 10) AS BIGINT) AS output_tokens FROM (
SELECT event_id AS id, ts + to_months((user_id % 3)::INT) AS ts,
  CASE event_type WHEN 'view' THEN 'git status' WHEN 'click' THEN 'cargo test' WHEN 'purchase' THEN 'npm run build' WHEN 'signup' THEN 'grep -rn' ELSE 'ls -la' END AS filtered_cmd,
  filtered_cmd || ' ' || (event_id % 7) AS original_cmd, CAST(floor(abs(value) * 100) AS BIGINT) AS input_tokens, event_id % 500 AS exec_time_ms,
  CASE WHEN user_id % 12 = 11 THEN '' WHEN user_id % 12 <> 10 THEN '/w/p' || (user_id % 12) || CASE WHEN event_id % 5 = 0 THEN '/sub' ELSE '' END END AS project_path,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 <> 1 THEN 'name' || (event_id % 3) END AS project_name,
  user_id::VARCHAR AS session_id, (event_id % 4)::INT AS parse_tier, CASE WHEN event_id % 9 = 0 THEN 'passthrough' ELSE 'filtered' END AS execution_kind
FROM events)))
""")


BOOKED_LATER = 3


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost that were spent per day. They are booked BOOKED_LATER days after the commands ran, so either side has days that the other lacks."""
    e = read(spark, sf_dir, "events")
    day = F.date_add(F.to_date(F.col("ts").cast("timestamp") + F.make_ym_interval(F.lit(0), (F.col("user_id") % 3).cast("int"))), BOOKED_LATER)
    v = F.floor(F.abs("value")).cast("long")
    return e.groupBy(day.alias("day")).agg(
        F.sum(v * 7).alias("input_tokens"), F.sum(v * 2).alias("output_tokens"), F.sum(v).alias("cache_creation_tokens"), F.sum(v * 11).alias("cache_read_tokens"),
        F.sum(v * 21).alias("total_tokens"), (F.sum(v) / 1000).alias("total_cost"),
    )


view("usage_daily_v", f"""
SELECT CAST(ts + to_months((user_id % 3)::INT) AS DATE) + {BOOKED_LATER} AS day, sum(v * 7)::BIGINT AS input_tokens, sum(v * 2)::BIGINT AS output_tokens,
  sum(v)::BIGINT AS cache_creation_tokens, sum(v * 11)::BIGINT AS cache_read_tokens, sum(v * 21)::BIGINT AS total_tokens, sum(v)::DOUBLE / 1000 AS total_cost
FROM (SELECT *, CAST(floor(abs(value)) AS BIGINT) AS v FROM events) GROUP BY 1
""")


def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("tool-"), F.col("event_id") % 17, F.lit(" --run")).alias("raw_command"),
        F.concat(F.lit("bad flag "), F.col("event_id") % 5).alias("error_message"), (F.col("event_id") % 3 != 0).alias("fallback_succeeded"), F.concat(F.lit("/w/p"), F.col("user_id") % 12).alias("project_path"),
    )


view("parse_failures_v", """
SELECT event_id AS id, ts, 'tool-' || (event_id % 17) || ' --run' AS raw_command, 'bad flag ' || (event_id % 5) AS error_message, event_id % 3 <> 0 AS fallback_succeeded, '/w/p' || (user_id % 12) AS project_path
FROM events WHERE event_type = 'error'
""")

ACTIONS = ("rewrite", "rewrite", "skip:ignored", "skip:unsupported", "skip:already_routed", "skip:no_match", "deny", "other")


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of the hook's audit log; some are malformed."""
    e = read(spark, sf_dir, "events")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("event_id") % 8 + 1).cast("int"))
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    cmd = F.concat(F.when(F.col("event_id") % 3 == 0, "CI=1 ").otherwise(""), F.lit("npx tool"), F.col("user_id") % 9, F.lit(" --x"))
    line = F.when(F.col("event_id") % 23 == 0, F.concat(ts, F.lit(" | broken"))).when(F.col("event_id") % 8 < 2, F.concat_ws(" | ", ts, action, cmd, F.concat(F.lit("short "), cmd))).otherwise(F.concat_ws(" | ", ts, action, cmd))
    return e.select(line.alias("value"))


view("audit_lines_v", """
SELECT CASE WHEN event_id % 23 = 0 THEN t || ' | broken' WHEN event_id % 8 < 2 THEN t || ' | ' || a || ' | ' || c || ' | short ' || c ELSE t || ' | ' || a || ' | ' || c END AS value
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t,
  ['rewrite', 'rewrite', 'skip:ignored', 'skip:unsupported', 'skip:already_routed', 'skip:no_match', 'deny', 'other'][event_id % 8 + 1] AS a,
  CASE WHEN event_id % 3 = 0 THEN 'CI=1 ' ELSE '' END || 'npx tool' || (user_id % 9) || ' --x' AS c FROM events)
""")

#: Outputs of failed calls, by event.
ERROR_TEXTS = (
    "error: unexpected argument '--amed' found", "bash: tool: command not found", "error: option requires an argument", "Permission denied: error 13", "cat: x: No such file or directory (cannot open)",
    "error[E0308]: mismatched types", "test result: FAILED. 1 failed", "error: the user declined this command", "unknown revision", "File not found error", "nothing to see",
)


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of agent sessions with their outputs, in order; one in 13 has no output."""
    e = read(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    base = F.element_at(F.array(F.lit("git commit"), F.lit("cargo build"), F.lit("npm run")), (user % 3 + 1).cast("int"))
    args = F.element_at(F.array(F.lit(" --amend -m x"), F.lit(" --amed -m x"), F.lit(" -m x --all"), F.lit(""), F.lit(" build/a b c d e f g h i j")), (event % 5 + 1).cast("int"))
    failed = F.col("event_type").isin("error", "signup")
    text = F.element_at(F.array(*[F.lit(t) for t in ERROR_TEXTS]), (event % len(ERROR_TEXTS) + 1).cast("int"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.lit("a").alias("source"), user.cast("string").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("sequence_index"),
        F.concat(F.when(event % 7 == 0, "CI=1 ").otherwise(""), base, args).alias("command"), F.when(event % 13 != 0, F.when(failed, text).otherwise("ok")).alias("output_content"), failed.alias("is_error"),
    ).withColumn("output_len", F.length("output_content").cast("long"))


view("tool_calls_v", f"""
SELECT *, length(output_content) AS output_len FROM (
SELECT 'a' AS source, user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_index,
  CASE WHEN event_id % 7 = 0 THEN 'CI=1 ' ELSE '' END || ['git commit', 'cargo build', 'npm run'][user_id % 3 + 1] || [' --amend -m x', ' --amed -m x', ' -m x --all', '', ' build/a b c d e f g h i j'][event_id % 5 + 1] AS command,
  CASE WHEN event_id % 13 <> 0 THEN CASE WHEN event_type IN ('error', 'signup') THEN [{", ".join("'" + t.replace("'", "''") + "'" for t in ERROR_TEXTS)}][event_id % {len(ERROR_TEXTS)} + 1] ELSE 'ok' END END AS output_content,
  event_type IN ('error', 'signup') AS is_error FROM events)
""")


def session_lines_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool_calls as a session log with message blocks; every 17th call is followed by a broken line."""
    calls = tool_calls(spark, sf_dir)
    ident = F.concat(F.lit("id"), F.col("sequence_index"))
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), ident.alias("id"), F.lit("Bash").alias("name"), F.struct("command").alias("input"))).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), ident.alias("tool_use_id"), F.col("output_content").alias("content"), "is_error")).alias("content")).alias("message")))
    broken = F.when(F.col("sequence_index") % 17 == 0, F.lit('{"type":"user","message":{"content":[{"type":"tool_result"'))
    return _numbered(calls, use, F.when(F.col("output_content").isNotNull(), result), broken)


def session_lines_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool_calls as a session log with JSON in JSON."""
    calls = tool_calls(spark, sf_dir)
    ident = F.concat(F.lit("id"), F.col("sequence_index"))
    args = F.when(F.col("sequence_index") % 2 == 0, F.to_json(F.struct(F.col("command").alias("cmd")))).otherwise(F.to_json(F.struct("command")))
    use = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.lit("exec_command").alias("name"), ident.alias("call_id"), args.alias("arguments")).alias("payload")))
    text = F.concat(F.lit("Process exited with code "), F.when(F.col("is_error"), "2").otherwise("0"), F.lit("\nOutput:\n"), F.col("output_content"))
    result = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call_output").alias("type"), ident.alias("call_id"), text.alias("output")).alias("payload")))
    meta = F.when(F.col("sequence_index") == 0, F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("/w/p"), F.col("session_id").cast("long") % 12, F.lit("/sub")).alias("cwd")).alias("payload"))))
    return _numbered(calls, meta, use, F.when(F.col("output_content").isNotNull(), result))


def _numbered(calls: DataFrame, *lines) -> DataFrame:
    rows = calls.select("session_id", "sequence_index", F.posexplode(F.array(*lines)).alias("i", "value")).filter("value is not null")
    return rows.select("session_id", (F.col("sequence_index") * 10 + F.col("i")).alias("line_no"), "value")


#: Command lines, and the parts that their chains have.
CHAINS = (
    ("git status && cargo test -- --nocapture", ("git status", "cargo test -- --nocapture")),
    ("cd src; git diff HEAD~1", ("cd src", "git diff HEAD~1")),
    ("cat a.txt | grep x && ls", ("cat a.txt | grep x && ls",)),
    ("echo 'a && b' || git log", ("echo 'a && b'", "git log")),
    ("CI=1 npx vitest run", ("CI=1 npx vitest run",)),
    ("mise exec -- pytest -q", ("mise exec -- pytest -q",)),
    ("sudo docker ps -a", ("sudo docker ps -a",)),
    ("python3 -m pip list", ("python3 -m pip list",)),
    ("make all", ("make all",)),
    ("bazel build //x", ("bazel build //x",)),
    ("git checkout main", ("git checkout main",)),
    ("pnpm exec eslint .", ("pnpm exec eslint .",)),
    ("terraform apply -auto-approve ; go vet ./...", ("terraform apply -auto-approve", "go vet ./...")),
    ("just -- cargo build", ("just -- cargo build",)),
    ("x=$((1+2)) && ls", ("x=$((1+2)) && ls",)),
    ("./run.sh --fast", ("./run.sh --fast",)),
    ("ls", ("ls",)),
)


def shell_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose commands are chains; one in four has no output."""
    e = read(spark, sf_dir, "events")
    event = F.col("event_id")
    chain = F.element_at(F.array(*[F.lit(t) for t, _ in CHAINS]), (event % len(CHAINS) + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), event.alias("sequence_index"), chain.alias("command"), F.when(event % 4 != 0, event % 4000).alias("output_len"))


def _sql_list(texts) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


view("shell_calls_v", f"""
SELECT user_id::VARCHAR AS session_id, event_id AS sequence_index, {_sql_list(t for t, _ in CHAINS)}[event_id % {len(CHAINS)} + 1] AS command, CASE WHEN event_id % 4 <> 0 THEN event_id % 4000 END AS output_len,
  [{", ".join(_sql_list(p) for _, p in CHAINS)}][event_id % {len(CHAINS)} + 1] AS parts FROM events
""")
view("shell_parts_v", "SELECT session_id, sequence_index, output_len, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS part_index FROM shell_calls_v")

PREFIXES = ("", "ERROR: ", "WARN ", "2024-01-01 10:00:00 INFO ", "error[E0308]: ", "    ", "", "\t", "fatal ", "  at f.js:10:2 ", "")
SUFFIXES = ("", " /usr/lib/x.py 12345", " 0xdeadBEEF", " 123e4567-e89b-12d3-a456-426614174000", "")
COMMANDS = ("cargo test", "npm run build", "kubectl logs", "git log", "pytest -q")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured outputs: output_id, command, exit_code, text."""
    return outputs_of(read(spark, sf_dir, "documents"))


def outputs_of(docs: DataFrame) -> DataFrame:
    command = F.element_at(F.array(*[F.lit(x) for x in COMMANDS]), (F.col("doc_id") % len(COMMANDS) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("output_id"), command.alias("command"), (F.col("doc_id") % 3).cast("int").alias("exit_code"), "text")


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of outputs, made to look like logs."""
    return lines_of(outputs(spark, sf_dir))


def lines_of(captured: DataFrame) -> DataFrame:
    rows = captured.select("output_id", "command", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    at = F.col("output_id") + F.col("line_no")
    prefix = F.element_at(F.array(*[F.lit(x) for x in PREFIXES]), (at % len(PREFIXES) + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (at % len(SUFFIXES) + 1).cast("int"))
    return rows.withColumn("line", F.when(at % 13 == 0, "").when(at % 13 == 1, "same line again").otherwise(F.concat(prefix, "line", suffix)))


view("outputs_v", f"SELECT doc_id AS output_id, {_sql_list(COMMANDS)}[doc_id % {len(COMMANDS)} + 1] AS command, (doc_id % 3)::INT AS exit_code, text FROM documents")
view("output_lines_v", f"""
SELECT output_id, command, line_no, CASE WHEN pos % 13 = 0 THEN '' WHEN pos % 13 = 1 THEN 'same line again' ELSE {_sql_list(PREFIXES)}[pos % {len(PREFIXES)} + 1] || line || {_sql_list(SUFFIXES)}[pos % {len(SUFFIXES)} + 1] END AS line FROM (
SELECT *, output_id + line_no AS pos FROM (
SELECT output_id, command, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM (SELECT output_id, command, string_split(text, chr(10)) AS ls FROM outputs_v)))
""")


def _tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tool outputs are made of: a row per event, an output per user."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(F.col("user_id").alias("output_id"), n.alias("n"), F.concat(F.lit("src/f"), n % 7, F.lit(".x")).alias("file"), (n % 90 + 1).cast("int").alias("line"), (n % 40 + 1).cast("int").alias("col"), F.concat(F.lit("R"), n % 9).alias("code"), F.concat(F.lit("message \"q\" "), n).alias("message"), (n % 3 == 0).alias("bad"))


view("tool_rows_v", """SELECT user_id AS output_id, event_id AS n, 'src/f' || (event_id % 7) || '.x' AS file, (event_id % 90 + 1)::INT AS line, (event_id % 40 + 1)::INT AS col, 'R' || (event_id % 9) AS code, 'message "q" ' || event_id AS message, event_id % 3 = 0 AS bad FROM events""")


#: A text of a tool's output holds events of one user whose ids share all but so many low bits, at most 2 ** BLOCK_BITS of
#: them; an output has as many texts as it needs, so a user may have any share of the events.
BLOCK_BITS = 14


def _tool_blocks(spark: SparkSession, sf_dir: str, element) -> DataFrame:
    """(output_id, part, a): the elements of each output in blocks, sorted by n within and across parts."""
    e = F.transform(F.sort_array(F.collect_list(F.struct("n", element.alias("e")))), lambda x: x["e"])
    return _tool_rows(spark, sf_dir).groupBy("output_id", F.shiftright("n", BLOCK_BITS).alias("part")).agg(e.alias("a"))


def tool_json(spark: SparkSession, sf_dir: str, element, wrap: str | None = None) -> DataFrame:
    """Outputs (output_id, text) in one or more texts that hold a JSON array of element for each row, sorted by n."""
    rows = _tool_blocks(spark, sf_dir, element)
    return rows.select("output_id", F.to_json(F.struct(F.col("a").alias(wrap)) if wrap else F.col("a")).alias("text"))


def tool_text(spark: SparkSession, sf_dir: str, line, numbered: bool = True) -> DataFrame:
    """Outputs (output_id, text, first_line) in one or more texts of one line for each row, sorted by n.

    first_line is the number of lines that the output has before a text; it
    takes a join, so readers to which lines mean nothing to each other leave
    it out with numbered=False.
    """
    texts = _tool_blocks(spark, sf_dir, line).select("output_id", "part", F.concat(F.array_join("a", "\n"), F.lit("\n")).alias("text"))
    if not numbered:
        return texts.select("output_id", "text")
    before = Window.partitionBy("output_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = texts.select("output_id", "part", F.size(text_lines(F.col("text"))).alias("k"))
    starts = starts.select(F.col("output_id").alias("_o"), F.col("part").alias("_p"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first_line"))
    return texts.join(starts, F.col("output_id").eqNullSafe(F.col("_o")) & F.col("part").eqNullSafe(F.col("_p"))).select("output_id", "text", "first_line")
