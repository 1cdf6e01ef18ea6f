"""The numbered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm import chat, decontamination, fingerprints, huffman, jaccard_join, licenses, periodic_runs, piece_sampling, quality, sharding, substring_dedup, token_alignment, toxicity
from trackledger.llm.oracles import ORACLES
from trackledger.llm.store import new_path, small_batches, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 24
SAMPLES = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = docs.select("doc_id", "text", F.explode(piece_sampling.encode_column(F.col("text"), F.col("doc_id"), model, SAMPLES)).alias("s"))
    return drawn.select(
        "doc_id",
        "s.sample",
        F.size("s.ids").cast("long").alias("n_tokens"),
        piece_sampling.ids_crc32(F.col("s.ids")).alias("ids_crc32"),
        "s.log_prob",
        "s.log_inclusion",
        (piece_sampling.decode_column(F.col("s.ids"), model) == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score_column(docs, model), 0.5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score_column(docs, model), 0.3)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlapping(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "window", "matched")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = turns.unionByName(spark.createDataFrame(probe, turns.schema))
    windows = written(chat.format_windows(turns, tokenizer_file("byte_bpe_50k.json")), "windows")
    return chat.read_back(windows)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "huffman")
    huffman.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), 2)
    return huffman.read_ids(spark, path).select(
        F.col("id").alias("doc_id"), "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.coalesce(F.sha2("groups", 256), F.lit(""))
    aligned = token_alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), groups=digest)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", periodic_runs.runs_column(periodic_runs.echoed_column(F.col("text"), F.col("doc_id"))).alias("r"))
    best = periodic_runs.strongest(F.col("r.runs"))
    found = found.select("doc_id", "r.runs", "r.collapsed", best.alias("b"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "b.start",
        "b.length",
        "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_license_scan": op7_license_scan,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_huffman_ids": op10_huffman_ids,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

__all__ = ["ORACLES", "QUERIES"]
