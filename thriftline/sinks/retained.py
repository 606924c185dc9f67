"""Raw outputs kept for later: the newest files of a folder, each of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.sinks.store import Store

#: Bytes from which on an output is kept, bytes of a file, files, and characters of a command in a file's name.
LEAST_BYTES, MOST_BYTES, MOST_FILES, SLUG_CHARS = 500, 1_048_576, 20, 40
FILES = "file_name string, output_id bigint, content string"


def file_name(seconds: Column, command: Column) -> Column:
    """Seconds since the epoch and the command, of which all but letters, digits, _ and - is _."""
    return F.concat(F.lpad(seconds.cast("string"), 10, "0"), F.lit("_"), F.substring(F.regexp_replace(command, "[^A-Za-z0-9_-]", "_"), 1, SLUG_CHARS), F.lit(".log"))


def capped(text: Column, most: int) -> Column:
    """text, or its first `most` bytes (no part of a character) and a note."""
    raw = F.encode(text, "utf-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)])  # a character has four bytes at most
    return F.when(F.octet_length(raw) > most, F.concat(cut, F.lit(f"\n\n--- truncated at {most} bytes ---"))).otherwise(text)


def wanted(outputs: DataFrame, mode: str = "failures", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Outputs to keep: never, only failures or always; small ones never, null ones neither."""
    if mode not in ("never", "failures", "always"):
        raise ValueError(f"mode {mode!r} is none of never, failures, always")
    if mode == "never":
        return outputs.limit(0)
    rows = outputs.filter(F.octet_length("text") >= least_bytes)
    return rows.filter("exit_code <> 0") if mode == "failures" else rows


def retain(outputs: DataFrame, store: Store, mode: str = "failures", least_bytes: int = LEAST_BYTES, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> int:
    """Add outputs (output_id, command, exit_code, captured_at in seconds, text) to the store's files and let the oldest beyond most_files go.

    Names decide what is newest; of files with one name the output of the
    largest id stays. Only the texts of the files that stay are moved.
    """
    rows = wanted(outputs, mode, least_bytes).withColumn("file_name", file_name(F.col("captured_at"), F.col("command")))
    newest = rows.groupBy("file_name").agg(F.max("output_id").alias("output_id")).orderBy(F.desc("file_name")).limit(most_files)
    new = rows.join(F.broadcast(newest), ["file_name", "output_id"]).dropDuplicates(["file_name"]).select("file_name", F.col("output_id").cast("long"), capped(F.col("text"), most_bytes).alias("content"))
    if store.versions():
        old = kept(store)
        new = new.unionByName(old.join(F.broadcast(newest.select("file_name")), "file_name", "left_anti").select(*new.columns))
    return store.commit({"files": (new.orderBy(F.desc("file_name")).limit(most_files), "parquet", {})})


def kept(store: Store) -> DataFrame:
    """(file_name, output_id, content) of the files that are kept."""
    return store.spark.read.schema(FILES).parquet(store.at("files"))
