"""Corpus preparation: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import mixing, packing, simhash, suffixes, toxicity
from holdfast.llm.arrow import free_name
from holdfast.llm.queries import THRESHOLD, table, tokenizer_path
from holdfast.llm.store import materialize

_FOLD = "crc32(cast(doc_id as string)) % 3 <> 1"


def _counted(docs: DataFrame, before: list[str]) -> DataFrame:
    """``docs`` with n_chars of the text as it is now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*before) if "n_chars" in before else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=_FOLD)
    score = free_name("__toxic", docs.columns)
    return toxicity.classify(docs, model, out=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles at Jaccard similarity 0.8 or more."""
    return simhash.deduplicate(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that start elsewhere too; those left empty go."""
    counts = ("n_bytes", "n_removed", "n_spans")  # columns of these names in ``docs`` step aside
    own = {c: free_name(f"__{c}", docs.columns) for c in docs.columns if c.lower() in counts}
    found = suffixes.remove_repeats(docs.withColumnsRenamed(own))
    kept = found.where(~((F.col("n_removed") > 0) & (F.trim("text") == ""))).drop(*counts)
    kept = kept.withColumnsRenamed({v: c for c, v in own.items()}).select(*docs.columns)
    return _counted(kept, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the budgets of their sources take them."""
    return _counted(mixing.apply_mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, learned scores and token ids are beyond SQL; tests hold each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
