"""The registered queries of the subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_shards, budget_mix, collision_search, context_mixing, cut_packing, hamming_tree, huffman_ids, language_id, license_rules, rotated_codes
from .token_cache import default_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision_search.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_hamming_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_tree.near_duplicates(table(spark, sf_dir, "documents"))


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_packing.pieces(table(spark, sf_dir, "documents"), default_path(), end_id=2, width=4096)


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.digests(*huffman_ids.write(table(spark, sf_dir, "documents"), default_path(), end_id=1))


def language_fold() -> Column:
    """crc32 of doc_id as text, modulo 4; documents of remainder 2 are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(language_fold() != 2))
    found = language_id.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (language_fold() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scanned(table(spark, sf_dir, "documents"))


def op7_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_shards.sharded(table(spark, sf_dir, "documents"), shards=16)


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    return context_mixing.scored(table(spark, sf_dir, "documents"), fold == 0)


def tree() -> dict[str, Column]:
    """Domain, language, source. Sources are named src0, src1, ...; their number modulo 4 is the domain."""
    number = F.try_to_number(F.regexp_extract("source", r"(\d+)$", 1), F.lit("999999999"))
    return {"domain": F.concat(F.lit("domain"), (number % 4).cast("int").cast("string")), "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {("domain0",): 2.0, ("domain1",): 3.0, ("domain2",): 3.0, ("domain3",): 2.0} | {(f"domain{k}", lang): w for k in range(4) for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))}


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mixed(table(spark, sf_dir, "documents"), tree(), budget_mix.Params(budget=1.0, epochs=2, weights=WEIGHTS))


QUERIES = {f.__name__: f for f in (op1_collision_search, op2_hamming_tree, op3_rotated_codes, op4_cut_packing, op5_huffman_ids, op6_license_rules, op7_best_fit_shards, op8_context_mixing, op9_budget_mix, op10_language_id)}

ORACLE_SQL: dict[str, str] = {"op3_rotated_codes": rotated_codes.oracle_sql(0.93), "op6_license_rules": license_rules.oracle_sql()}
