"""From raw documents to packed training sequences: quality, language, near duplicates, repeats, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import codec, langid, neardup, packing, quality, suffix
from loomspan.llm.common import read_table, staged


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null and empty texts go; repeated rows stay or go together; no row gives none."""
    return quality.keep_good(docs)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language, learned from all labelled documents, makes up half at least.

    Null texts and texts without a letter go, and all go where no document has a language; repeated rows stay or go together.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by 64-bit hashes of id and text, so rows without an id or with a
    repeated one count on their own. The smallest id of a group stays, none before any; of rows with equal id and text one stays.
    Null, empty and wordless texts are like no other, and stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = neardup.near_duplicates(keyed, id_col="_key", width=5, percent=80).select("_key", "component_id").distinct()
    first = keyed.select("_key", "doc_id").join(found, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_first"))
    out = keyed.join(first.select(F.col("_first._key").alias("_kept")), F.col("_key") == F.col("_kept"), "left_semi")
    return out.drop("_key").dropDuplicates(["doc_id", "text"])


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur elsewhere; ``n_chars`` follows.

    Every row stays, if with an empty text; a null text becomes the empty one. Repeated rows lose what they share.
    """
    return suffix.cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. A null or empty text has one token, the end; repeated rows are packed each."""
    return packing.pack_documents(docs, codec.tokenizer_path(), 4096, 1)


STAGES = [("quality", good), ("language", identified), ("near_duplicates", one_of_each), ("repeats", unrepeated), ("packing", packed)]

#: SQL has no way to say these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
