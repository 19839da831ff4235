"""Documents through five stages: quality rules, near-duplicates, repeated passages, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and reads it again as the next stage's documents, and removes what a stage left there.

For all stages: an empty table gives an empty one with the same columns; columns other than those of
``COLUMNS`` are left out, so no name can clash; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrack.llm import decontaminate, mixing, quality_rules, simhash, suffix_dedup
from kinetrack.llm.storage import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go (they fail the rules), null doc_ids stay if their text is good, and of repeated
    rows all stay or none: rows with one doc_id and text get one verdict.
    """
    return quality_rules.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, then the smallest hash of the text.

    Rows go by doc_id and a hash of the text, so rows that repeat a doc_id stay apart.  A null doc_id comes
    after all others: such a row stays where its group has no other.  Of equal rows one stays.
    """
    keys = {"q_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "q_text": F.xxhash64("text")}
    rows = docs.select(*COLUMNS).withColumns(keys)
    # equal texts have equal fingerprints, so groups of texts are groups of rows
    found = simhash.near_duplicates(rows.select(F.col("q_text").alias("doc_id"), "text"))
    groups = found.groupBy(F.col("doc_id").alias("q_text")).agg(F.min("component_id").alias("component"))
    first = rows.groupBy("q_text").agg(F.min("q_id").alias("q_id")).join(groups, "q_text")
    first = first.groupBy("component").agg(F.min(F.struct("q_id", "q_text")).alias("first")).select("first.*")
    return rows.join(first, list(keys), "left_semi").dropDuplicates(list(keys)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 400 bytes or more that stand elsewhere too.

    Documents in which nothing but white space is left go: null, empty and wholly repeated texts (repeated
    rows of 400 bytes or more among them).  Null doc_ids stay.
    """
    found = suffix_dedup.repeated_spans(docs.select(*COLUMNS), carry=["lang", "source"])
    rows = found.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; repeated rows, null doc_ids and texts without words stay."""
    found = decontaminate.with_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("contamination.n_hit = 0").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, posteriors, rate and copies of the documents that the mixture takes at least once.

    Repeated rows are rows of their own; a null doc_id has no label, but a rate like any other; a text
    without words keeps the rate 1.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels")).where("copies > 0")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("mixing", mixture),
]

#: XXH64 fingerprints, their components and the iterated fits are beyond SQL; tests run brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark, name.replace(" ", "-")) as path:
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
