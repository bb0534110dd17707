"""The corpus pipeline: five stages over ``documents``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import Scratch, table
from batchloom.llm.mixing import replicate
from batchloom.llm.near_copies import keep_one
from batchloom.llm.pieces import Model, encode
from batchloom.llm.quality import classify
from batchloom.llm.surrogates import pseudonymise


def same_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, also where an operator has a result of that name."""
    return found.select(*[F.col(f"`input_{c}`").alias(c) if f"input_{c}" in set(found.columns) - set(docs.columns) else F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.

    Null and empty texts go. A document of a language (null is one of its own) without trusted
    text stays. Each row is judged by itself, so repeated rows stay or go together; an empty table
    gives none, and further columns pass through.
    """
    return same_columns(classify(docs, table(spark, sf_dir, "labels"), Scratch(spark)).where("_keep"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash of five-word shingles, links decided at Jaccard 0.8): that of the smallest doc_id.

    Texts without words, null ones among them, are one group. Of repeated rows with the smallest
    id any one stays; a null id counts only where a group has no other. An empty table gives none,
    and further columns pass through.
    """
    return keep_one(docs, Scratch(spark)).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates, n_chars counted anew.

    Null texts stay null and empty ones empty. Equal entities get equal surrogates in all rows, so
    repeated rows stay equal; an empty table gives none, and further columns pass through.
    """
    return same_columns(pseudonymise(docs, Scratch(spark)), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards equal weights of the sources, in shuffled order.

    A null source is one of its own, a null doc_id counts as one id. Rows of one id and source get
    one count each. A source without characters keeps its rows at a rate of 1; an empty table gives
    none, and further columns pass through.
    """
    return same_columns(replicate(docs), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy with the ids of its text: doc_id, lang, source, n_chars, ids.

    Null and empty texts have no ids. Repeated rows stay separate rows; an empty table gives none;
    further columns are left out.
    """
    import public_tokenizers

    named = docs.select("doc_id", "text", "lang", "source", "n_chars")
    encoded = encode(named, Scratch(spark), Model.read(str(public_tokenizers.path("piece_bpe_32k.model"))))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.col("_ids").alias("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("pieces", pieces)]

#: The language model, SimHash and the lattice are not expressible in DuckDB; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
