"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
its context, and only its text is trainable. A conversation that does not end
with an assistant turn gives one more example without a trainable part, so
that its last turns are in the output too.

Template of a turn: OPEN role CLOSE text END. Inside roles and texts the
characters that control strings are made of are escaped, so that a control
string never comes from data and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<s>[", "]", "</s>"
#: Escapes, in the order of escaping; undone in the other order.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
SEGMENT = "struct(turn, role, text)"


def escaped(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def expand_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, target long, n_turns int, formatted string, loss_start int, loss_length int), one row per example.

    target is the place of the trainable turn (from 1), null in the example
    that only has context. loss_start (from 0) and loss_length count code
    points of formatted, as escaped. Turns come in the order of (turn, role,
    text), so ties and repeated rows have a fixed place and each stays. A null
    role or text is empty; a null conv_id is a conversation of its own. Other
    columns are not read. An example holds its whole context, so the output of
    a conversation grows with the square of its turns: that is the format.
    """
    convs = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(CLOSE), escaped(t["text"]), F.lit(END))).alias("segments"),
    )
    n = F.size("segments")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("roles", i - 1) == "assistant") | (i == n))
    rows = convs.select("conv_id", "roles", "segments", F.explode(targets).alias("n_turns"))
    trained = F.get("roles", F.col("n_turns") - 1) == "assistant"
    head = F.length(F.lit(OPEN + "assistant" + CLOSE))
    last = F.length(F.get("segments", F.col("n_turns") - 1))
    rows = rows.select(
        "conv_id", F.when(trained, F.col("n_turns")).cast("long").alias("target"), "n_turns",
        F.array_join(F.slice("segments", 1, F.col("n_turns")), "").alias("formatted"),
        F.when(trained, last - head - len(END)).otherwise(0).alias("loss_length"),
        last.alias("last"),
    )
    return rows.select("conv_id", "target", "n_turns", "formatted", (F.length("formatted") - F.when(F.col("target").isNotNull(), F.col("loss_length") + len(END)).otherwise(0)).alias("loss_start"), "loss_length")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    segments = F.filter(F.split(formatted, END, -1), lambda s: s != "")

    def parse(s: Column) -> Column:
        rest = F.substring(s, F.lit(len(OPEN) + 1), F.length(s))
        role = F.substring_index(rest, CLOSE, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(rest, F.length(role) + len(CLOSE) + 1, F.length(rest))).alias("text"))

    return F.transform(segments, parse)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their formatted text and loss spans."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    per = examples.select("conv_id", "target", "n_turns", "formatted", loss.alias("loss"))
    per = per.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    per = per.withColumn("turns", read_turns(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def with_planted(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose texts look like control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    turns = F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for i, role in enumerate(("user", "assistant"))])
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.range(1).select(F.inline(turns)))


#: op8 for DuckDB, straight from the turns.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(9 + length(role) + length(text) + length(regexp_replace(role || text, '[^~<\[\]]', '', 'g'))) OVER w AS so_far
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
