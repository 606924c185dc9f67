"""The corpus pipeline: five operators in a row over documents.

Each stage takes the rows that the stage before it kept, read back from
Parquet, and its decisions take effect: what it rejects goes, what it changes
is changed. All but the last return the columns of documents. A stage's result
must be written before the next stage begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from thriftline.llm import jaccard_join, lang_id, line_dedup, pfair, sentencepiece_fst
from thriftline.llm.common import drop_paths, shared_dir, stashes_of, table


#: By application: what the stage before wrote on its way. Its result is written by the time the next stage begins, which drops it.
_left: dict[str, list[str]] = {}


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage for callers that take STAGES one by one; run() keeps a list of its own for the stages as they are."""

    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        drop_paths(spark, left)
        with stashes_of() as paths:
            made = run(spark, docs, sf_dir)
        left.extend(paths)
        return made

    stage.plain = run
    return stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts that are null, have no letter or fit no language go."""
    return lang_id.accepted(docs)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents repeat, which stay in the last of those documents."""
    return line_dedup.deduped(docs)


@_stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each_group(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, laid out in the order in which the mix reads its sources."""
    return pfair.in_mix_order(docs)


@_stage
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their piece ids, the text as the ids give it back, and mix_slot and mix_offset, by which they read as the mix."""
    return sentencepiece_fst.tokenized(pfair.in_mix_order(docs, slots=True))


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", to_pieces),
]

#: The stages train a classifier and follow links; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, and dropped once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/thriftline-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with stashes_of() as paths:
            stage.plain(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        drop_paths(spark, [*paths, *([f"{base}/{i - 1}"] if i else [])])
        docs = spark.read.parquet(f"{base}/{i}")
    return STAGES[-1][1].plain(spark, docs, sf_dir)
