"""Cleaning and packing of a corpus in stages, each written and read again before the next.

Toxic documents go, then those of low quality; one document of each group of near duplicates stays; of
passages that repeat across documents the first stays; what is left is tokenised and packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismopair.llm import common, minhash, packing, quality, suffix, toxicity
from seismopair.llm.queries import tokenizer_file

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, with all their columns as they are.

    A null text is scored as the empty one, equal texts alike; without labels every document has the same score. An empty table stays empty.
    """
    return toxicity.ordinary_rows(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, with all their columns as they are.

    A null text is scored as the empty one, equal texts alike; without labels every document has the same score. An empty table stays empty.
    """
    return quality.good_rows(docs, quality.train(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, with all its columns as they are.

    A row without an id stays, and so does one without words; rows that share an id stay or go together. An empty table stays empty.
    """
    gone = common.stage(minhash.groups(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand in one of smaller id; n_chars is counted anew, other columns stay as they are.

    A null text becomes the empty one. A row without an id keeps its text and takes none from others. An empty table stays empty.
    """
    return suffix.clean(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and offset; other columns are not carried.

    A null or empty text is the one token that ends a document; a long one is cut into full sequences and a rest. Rows that share an id, or their whole text,
    are packed each for itself. An empty table gives no pieces.
    """
    return packing.pack(packing.tokenize(docs, tokenizer_file("word_bpe_49k.json"), end_id=2), docs.count())


STAGES: list[Stage] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: Classifiers, groups of links and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of documents; a stage's table goes once the next one's stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, common.stage(step(spark, docs, sf_dir), name)
        common.release(before)
    return docs
