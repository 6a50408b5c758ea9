"""The registered queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, divergence, exact, licenses, packing, pii, simhash, substring, suffix, token_files, toxicity, vectors
from .shared import frugal, importable

#: Of the registered query; a real corpus has its own.
PII_KEY = "a key for tests"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    frugal(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The file of a public tokenizer, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier elsewhere go."""
    found = substring.deduplicated(table(spark, sf_dir, "documents"), width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; labels of the held-out quarter are not learnt."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 400-byte strings that are there twice go."""
    found = suffix.deduplicated(table(spark, sf_dir, "documents"), width=400)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in as few sequences of 2,048 as best fit finds."""
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.98."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written as directly addressable codes and read back."""
    blocks = token_files.write_blocks(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read_blocks(blocks)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten words of a benchmark item."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    items = F.size("items").cast("bigint").alias("n_items")
    named = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", items, named, (F.col("n_hit") > 0).alias("contaminated"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under format-preserving pseudonyms."""
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY, found="found")
    kinds = F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds")
    return found.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), kinds)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 4-word shingles, linked at four differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, by bytes: the largest doc_id of a group stays."""
    found = exact.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and the cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    report, turns = dialogue.repaired(dialogue.damaged(conversations))
    every = conversations.select("conv_id").distinct()
    found = every.join(report.withColumnRenamed("conv_id", "_r"), F.col("conv_id").eqNullSafe(F.col("_r")), "left")
    found = found.join(dialogue.digests(turns).withColumnRenamed("conv_id", "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's divergence from the other sources of its language, and its own terms."""
    return divergence.divergences(table(spark, sf_dir, "documents"), least=3, top=200)


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_token_files": op7_token_files,
        "op8_decontamination": op8_decontamination,
        "op9_pii": op9_pii,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_source_divergence": op13_source_divergence,
    }
