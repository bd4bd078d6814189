"""From raw documents to tokens, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last keep
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tidemark.llm.queries import QUERIES, query, table, word_vocabulary
from tidemark.session import cut_lineage

__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "run"]


#: Columns the stages read or write; any other is carried along untouched.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(stage: Stage) -> Stage:
    """The other columns go through a stage under names of their own, whatever the
    operator calls its results."""

    @wraps(stage)
    def run_aside(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = {name: name if name in DOCUMENTS else f"__own_{place}" for place, name in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*held.values()), sf_dir)
        return out.select(*(F.col(own).alias(name) for name, own in held.items()))

    return run_aside


@_aside
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that score below 0.7."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


@_aside
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an equal or near line precedes go; every document stays, if
    need be without text."""
    held = line_dedup.dedup_lines(docs)
    cut = F.size("dropped") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return held.withColumns(changed).select(*docs.columns)


@_aside
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts of similar shingles the smallest id stays."""
    return jaccard_join.one_of_each(docs, jaccard_join.join_classes(docs))


@_aside
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more lies in benchmark windows."""
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.where("NOT contaminated").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and the digest of what they decode to."""
    path = word_vocabulary()
    rows = bpe.decode_ids(bpe.encode_texts(docs, path), path)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", to_tokens),
]

#: The classifier and the tokens have no SQL; the stages are tested one by one.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
