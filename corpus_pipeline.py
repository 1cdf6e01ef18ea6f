"""The training-data pipeline: documents in, sampled token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last keep the columns
of ``documents``.  Every stage works on all rows that the one before it kept.

Odd rows, in every stage: null, empty and blank texts are scored like any other text without
words, are near copies of nothing, overlap with no benchmark item, and have one empty sample.
Rows with a null id are kept and dropped by their text alone.  Repeated rows are near copies
of each other, so one of them stays; rows that share an id but not the text are decided each
on its own.  An empty table gives an empty table; without labels no document is toxic
and all are good.  Further columns pass through unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.llm import decontamination, jaccard_join, piece_sampling, quality, toxicity
from trackledger.llm.queries import SAMPLES, table, tokenizer_file
from trackledger.llm.store import small_batches, written

TOXIC_FROM = 0.5
GOOD_FROM = 0.3
#: Near copies are documents whose shingles of so many words have at least this similarity, in percent.
NEAR_WORDS = 5
NEAR_PERCENT = 80

#: SQL has no classifiers, seeds or samplers; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), GOOD_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.keep_one_of_each(docs, percent=NEAR_PERCENT, words=NEAR_WORDS)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, sample, n_tokens, ids, log_prob, log_inclusion): the drawn segmentations of each document."""
    small_batches(spark)
    drawn = piece_sampling.encode_column(F.col("text"), F.col("doc_id"), tokenizer_file("piece_bpe_32k.model"), SAMPLES)
    rows = docs.select("doc_id", F.explode(drawn).alias("s"))
    return rows.select("doc_id", "s.sample", F.size("s.ids").cast("long").alias("n_tokens"), "s.ids", "s.log_prob", "s.log_inclusion")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_overlaps),
    ("sentencepiece_sampling", sample_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
