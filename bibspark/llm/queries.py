"""The thin queries over the operators: production parameters, whole tables, and the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, convnet, embeddings, files, lines, mixing, packing, simhash, sql, token_files, warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = files.scratch(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), uri, tokenizer_path(TOKENIZER))
    read = token_files.read(spark, uri)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.quality_rules(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")
    return found.select("doc_id", *(F.col(f"rule_{c}").alias(c) for c in names))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "dedup_lines", "dedup_removed")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = files.scratch(spark, "warc")
    names = [name for name, _ in warc.write(table(spark, sf_dir, "pages"), uri)]
    return warc.read(spark, uri, names, payloads=False).drop("target_uri")


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.allocate(table(spark, sf_dir, "documents"))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    # Unsigned, 16 digits, lower case.
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return convnet.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=held_out)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_embeddings": op4_embeddings,
    "op5_warc": op5_warc,
    "op6_brown": op6_brown,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_quality_net": op9_quality_net,
    "op10_packing": op10_packing,
}

#: DuckDB SQL for those queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": sql.QUALITY_RULES, "op3_line_dedup": sql.LINE_DEDUP}
