"""The corpus pipeline: quality, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has doc_id, text, lang, source and n_chars, and all stages but the
last return these columns. A stage works on the rows that its predecessor kept. Null texts are empty texts; an empty table
passes through every stage; further columns of docs are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passwatch.llm import bpe, decontaminate, pii, quality, simhash
from passwatch.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score reaches the threshold; the ranker learns from the labels of docs."""
    docs = docs.select(*COLUMNS)
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, ranker, "text", COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near copies.

    Copies are linked by SimHash fingerprints of three-word shingles at two bits or fewer, as in op7_simhash; fingerprints say nothing about texts that are less alike, so
    the sets of five-word shingles follow, at a similarity of 0.8 or more. A document stays that is the first of its group by both.
    Only ids, fingerprints and sets of shingle hashes are shuffled to find the groups; a text moves once, with its id. A row without an id goes by the hash
    of its columns, after all ids: it stays where its group has no id, and once where rows are the same in every column.
    """
    unnamed = F.col("doc_id").isNull()
    docs = docs.select(*COLUMNS).withColumn("__key", F.struct(unnamed.alias("unnamed"), F.coalesce("doc_id", F.xxhash64(*COLUMNS)).alias("id")))
    prints = written(simhash.fingerprints(docs, "text", ["__key"], width=3), "prints")
    first = lambda groups: groups.where("component_id = __key").select("__key").distinct()
    near = first(simhash.near(docs, "__key", "text", width=5, similarity=0.8))
    least = written(first(simhash.grouped(prints, "__key", budget=2)).join(near.hint("merge"), "__key"), "least")
    kept = docs.join(least, "__key", "left_semi")
    return kept.where(~unnamed).select(*COLUMNS).unionByName(kept.where(unnamed).select(*COLUMNS).distinct())


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that overlap with no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows the new text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and whether decoding them gives the text again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.encode(docs, "text", path, public_tokenizers.PATTERN, ["doc_id", "lang", "source", "text"], decoded="decoded")
    exact = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("PII", pii_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]
#: SQL expresses neither the ranker nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
