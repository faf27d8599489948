"""The corpus pipeline: quality rules, near-duplicate groups, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next stage's documents. All stages but the last return the columns of ``documents``.

The mixing stage keeps every document and repeats those of sources below their target, so that the written
table has the target shares. A written table has no order, so the encoding stage, which replaces each text by
its pieces, returns each row's slot and place in the mixing schedule too. SQL can't express the encoding, so
the whole is tested against brute force instead (tests/llm/test_pipeline.py).

Defined cases, stage by stage: an empty table stays empty; repeated rows are treated alike; a null source is
a source of its own; further columns pass through whatever their names. Other cases are said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import mixing
from glyphlake.llm.ngram_join import one_of_each_group
from glyphlake.llm.quality import reject_low_quality
from glyphlake.llm.sentencepiece_fst import DEFAULT_MODEL, encode_column
from glyphlake.llm.shared import Scratch
from glyphlake.llm.window_index import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go, null, empty and short texts among them."""
    return reject_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; rows without id or text stay."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; texts left without a word go, rows without id stay as they are."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of sources below their target repeated; rows without id or text are rows like any other."""
    return mixing.repeat_to_targets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece numbers (null for a null text); each row gets its slot and place in the mixing schedule."""
    once = mixing.distinct_with_slots(docs, mixing.scheduled(docs))
    placed = mixing.spread_over_slots(encode_column(once, DEFAULT_MODEL, forget=True))
    return placed.selectExpr("doc_id", "lang", "source", "n_chars", "cast(size(ids) as bigint) as n_pieces", "ids", "slot", "place")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again, and deleted once the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = scratch.put(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
