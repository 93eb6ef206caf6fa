"""The corpus pipeline: quality rules, quality classifier, SimHash near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and calls one operator of
``rootloom.llm``; all but the last return the columns of ``documents``.

Rows are judged one by one, whatever their ids: null ids and ids that come twice lose nothing but what is rejected itself. Null
texts count as empty and are rejected by the rules; texts of any length are read whole; columns beside doc_id and text are
handed through as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootloom.llm.fertility_rules import apply_rules
from rootloom.llm.near_copies import mark_rows, rejected_rows
from rootloom.llm.packing import pack_documents
from rootloom.llm.quality_qda import classify_quality
from rootloom.llm.shared import kept, new_folder, table, whole_row

#: Broadcast only up to so many row keys to drop (about 16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fertility bands, each row judged by its own text; equal rows are kept or go alike."""
    return apply_rules(docs, carry=True).where("kept").select(*whole_row(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with predicted quality 1, learned from the labels of the documents that are still there (without labels of both kinds: by the prior alone)."""
    return classify_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select(*whole_row(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id.

    Rows are told apart by a key of their own, not by doc_id: null and repeated ids lose nothing but near copies.
    """
    marked = kept(mark_rows(docs), "marked")
    rejected = kept(rejected_rows(marked), "rejected")
    small = rejected.count() <= BROADCAST_IDS
    return marked.join(F.broadcast(rejected) if small else rejected, "row_key", "left_anti").select(*whole_row(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents that are left, in sequences of 2048 tokens at most."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-duplicates", near_duplicates),
    ("best-fit packing", packing),
]
#: Tokenisers, covariances and subset sums have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        at = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.schema(docs.schema).parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
