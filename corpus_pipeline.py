"""A corpus pipeline over `documents`: each stage applies one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treescan.llm import mixing, packing, passages, simhash, toxicity
from treescan.llm.shared import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic.

    Every row is judged for itself, so repeated rows and ids have one answer each. Null and empty texts have the score of a
    text without n-grams. Null ids, languages and sources stay as they are. Columns besides those of documents, whatever
    their names, come along. An empty table gives no rows.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return toxicity.judged(docs, model).where("given_predicted = 0").select(F.col("given.*")).select(*kept)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id.

    SimHash fingerprints with the general pigeonhole find the candidates. Null and empty texts are copies of each other; rows with a null doc_id stay; of
    rows with one doc_id the smallest text stays. Other columns, whatever their names, come along. An empty table gives no rows.
    """
    return simhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat earlier ones.

    Null and empty texts stay; a document of which nothing is left goes. Rows with one doc_id and text are one document and are cut
    alike. Ties go to the smaller doc_id, null ids last. n_chars is that of the new text. Other columns,
    whatever their names, come along. An empty table gives no rows.
    """
    return passages.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix; those of scarce sources come once for each epoch.

    Null languages and sources are names of their own; null and empty texts have no tokens and come along. Repeated ids
    stand at one place of their leaf's order. Other columns, whatever their names, come along. An empty table gives no rows.
    """
    return mixing.mix(docs, mixing.target(spark), mixing.domain_of(), epochs=mixing.EPOCHS, seed=mixing.SEED, names=("mixed_epoch", "mixed_tokens")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 tokens, as pieces of documents with their token ids.

    Null and empty texts are the end id alone. Repeated rows and ids are packed as often as they occur; a null doc_id stays
    null. Other columns are ignored. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has no classifier, no fingerprint and no tokenizer. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
