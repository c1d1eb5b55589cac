"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the
last return the columns of documents. run() applies them in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_cnn, line_dedup, mixing, near_copies, packing
from granary.llm.common import as_row
from granary.llm.queries import MIX_WEIGHTS, mix_levels, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a score below the threshold go."""
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.score(docs, net, as_row(docs)).where(F.col("score") >= byte_cnn.THRESHOLD).select("row.*")


def fewer_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that many documents share go; n_chars follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 finds the candidates over five-word shingles; of each group of true similarity 0.8 and more one document stays."""
    return near_copies.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents to target weights; a document may be taken in several epochs, as so many rows."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS).select("row.*")


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of the training windows with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", fewer_lines),
    ("simhash_near_dedup", no_near_copies),
    ("source_mixing", mixed_sources),
    ("packing", packed_windows),
]
#: A trained network's scores are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
