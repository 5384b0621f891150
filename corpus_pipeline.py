"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents. SQL cannot express the classifier, the mix or the tokeniser, so there is no oracle; the tests hold run()
against a plain version on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.llm import mixing, ngram_join, packing, pii, quality
from vaultframe.llm.common import intermediates, remove, small_batches, table, written


def _measured(df: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    # As in the operator's own query, a fifth of the labels is never learnt from.
    model = quality.learn(docs, table(small_batches(spark), sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.score(docs, model, into="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by placeholders."""
    small_batches(spark)
    return _measured(pii.redact(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each document and pass that gives words, with those words."""
    small_batches(spark)
    return _measured(mixing.documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences."""
    import public_tokenizers

    small_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good), ("ngram_join", distinct), ("pii", private), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage keeps in the shared folder goes as soon as its result is written, and that as soon as the next one's is."""
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with intermediates() as made:
            docs = written(stage(spark, docs, sf_dir))
        for path in [*held, *made[:-1]]:
            remove(spark, path)
        held = made[-1:]
    return docs
