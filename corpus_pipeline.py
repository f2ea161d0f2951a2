"""Corpus preparation: stages over the documents table, each with one operator's decisions applied.

Every stage takes all that its predecessor kept. Rows with a null doc_id are compared like others; null texts
pass every stage but the last, where their tokens are null; of rows that are alike in id and text one stays, and
rows with one id and different texts are documents of their own; columns beside those of documents are carried along,
whatever their names, as long as they aren't those that the last stage adds (tokens, n_tokens, round_trip), which it
replaces. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.bpe import encode
from voxlake.llm.decontaminate import clean_documents
from voxlake.llm.near_dedup import near_duplicate_groups
from voxlake.llm.pii import without_private
from voxlake.llm.quality import keep_selected
from voxlake.llm.tables import drop_keys, read, small_batches
from voxlake.operators.components import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects stay."""
    return keep_selected(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id; one row of each id and text."""
    small_batches(spark)
    if not repeated(docs):
        gone = cut(near_duplicate_groups(docs).where("not is_kept").select("doc_id"))
        return drop_keys(docs, gone, "doc_id", gone.count())
    # ids don't tell rows apart: what tells documents apart is the id, or its lack, with a digest of the text
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    key = F.concat(F.coalesce(F.lpad(own.cast("string"), 20, "0"), F.lit("~")), F.lit("/"), F.coalesce(F.sha2(text, 256), F.lit("null")))
    rows = cut(rows.withColumn("key", key).dropDuplicates(["key"]))
    gone = cut(near_duplicate_groups(rows, "key", f"c{names.index('text')}").where("not is_kept").select("doc_id"))
    return drop_keys(rows, gone.toDF("key"), "key", gone.count(), 120).drop("key").toDF(*names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with [KIND] for each personal detail in the text."""
    small_batches(spark)
    return without_private(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their tokens and whether these decode to the text again."""
    small_batches(spark)
    return encode(docs)


def repeated(docs: DataFrame) -> bool:
    """Whether a doc_id is in more than one row, or null."""
    return not docs.where("doc_id is null").isEmpty() or not docs.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty()


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", private),
    ("byte_bpe", tokens),
]

#: Not all of the stages can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each one's rows cut from their lineage."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
