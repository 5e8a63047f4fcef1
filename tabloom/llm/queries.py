"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import (
    divergence, html_text, lattice, line_dedup, minhash, mixing, multi_index, packing, quality, repeats, repetition, resample, subword_lm,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _register(name: str, statement: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return keep


@_register("op9_mix_sources", mixing.SQL)
def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).drop("copies")


@_register("op6_pack_best_fit")
def op6_pack_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"))


@_register("op8_line_dedup", line_dedup.SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents")).drop("kept_text")


@_register("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), k=3, num=85, den=100)


@_register("op3_lattice_near_dedup")
def op3_lattice_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, folder, "embeddings"), threshold=0.9)


@_register("op5_multi_index_search")
def op5_multi_index_search(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(_table(spark, folder, "embeddings"), every=20, k=20)


@_register("op7_subword_lattice_score")
def op7_subword_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    return subword_lm.score(_table(spark, folder, "documents"))


@_register("op2_quality_posterior")
def op2_quality_posterior(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register("op10_html_text")
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


@_register("op4_repeated_passages")
def op4_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents"))


@_register("op11_repetition_rules", repetition.SQL)
def op11_repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.rules(_table(spark, folder, "documents")).drop("longest", "n_repeats", "spans")


@_register("op12_importance_resample", resample.SQL)
def op12_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("n_words")


@_register("op13_source_divergence", divergence.SQL)
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))
