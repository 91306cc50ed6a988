"""A training corpus from raw documents: rules, line dedup, near-dedup, mixing and packing, each stage written as Parquet.

Counted as part of the subpackage bibspark.llm.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import files, lines, mixing, packing, simhash
from bibspark.llm.queries import TOKENIZER


def _with_text(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs, with this text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and the others lose the lines above the limits.

    Null and empty texts, and texts of under 50 words, are rejected; repeated rows go or stay together; see lines.quality_rules.
    """
    return _with_text(lines.quality_rules(docs).filter(files.free(docs, "rule_kept")), docs, files.free(docs, "rule_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document that loses its last line goes too.

    Null and empty texts lose nothing and stay; repeated rows go or stay together; see lines.line_dedup.
    """
    found = lines.line_dedup(docs)
    removed, every = (F.col(files.free(docs, c)) for c in ("dedup_removed", "dedup_lines"))
    return _with_text(found.filter((removed == 0) | (removed < every)), docs, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, null first; of repeated rows one.

    Null and empty texts are one group; see simhash.deduplicated.
    """
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it.

    A null text has no words and the null source is a source; repeated rows are taken alike; see mixing.allocate.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids; a null text is empty and yields the end id alone; see packing.pack_documents."""
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("simhash", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can't express the stages from near-dedup on; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's scratch tables go once its result is written.  An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = files.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return docs
