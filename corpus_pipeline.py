"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes all documents its predecessor kept; every stage but the last returns the columns of documents.
Stages are written as Parquet under the shared folder and read again by the next.

Edge cases: null and empty texts, and all under ten words, fail the quality rules; very long texts are rows like any other;
rows that repeat id and text, and of near copies all but the row of the smallest id (a null id is the largest), go in the
second stage; an empty table stays empty; further columns of any name are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonecast.llm import arrowtext, decontaminate, jaccard_join, packing, pii_crf, quality_rules
from tonecast.llm.queries import table, tokenizer_file
from tonecast.session import materialize

# near duplicates, personal data and packing are not expressible in SQL
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base or quality rule rejects."""
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    return quality_rules.judge(whole).where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of its 5-word shingles one row, of the smallest id.

    Rows without words are linked with nothing; of rows that repeat id and text one stays. A null id counts as the largest.
    """
    groups = jaccard_join.linked_groups(docs, sim=jaccard_join.Similarity(5, 80, 100))
    first = groups.where("leads").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = keyed.join(first, keyed["id"].eqNullSafe(first["_id"]) & (keyed["hash"] == first["_text"]), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("doc.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up less than one word in twenty."""
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    judged = decontaminate.contaminated(whole, table(spark, sf_dir, "benchmark"))
    return judged.where("NOT contaminated").select("_doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by the name of its kind in brackets; n_chars follows the new text."""
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    found = pii_crf.find(whole, with_masked=True)
    changed = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"_doc.`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of at most 2048 tokens."""
    # rows that carry ids are large, so tasks get few at a time
    with arrowtext.small_batches(spark):
        return materialize(packing.pack(docs, tokenizer_file(), with_ids=True).select(
            "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"), "packed")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free),
          ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
