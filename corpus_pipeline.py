"""A pipeline from raw documents to token ids: language ID, near duplicates, secrets, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; run() writes each result and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import table
from meridian.llm.language_id import identify
from meridian.llm.ngram_join import drop_near_copies
from meridian.llm.queries import vocabulary
from meridian.llm.secrets import scan_secrets
from meridian.llm.source_mix import mix_sources
from meridian.llm.word_bpe import encode_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected ones go."""
    return identify(docs, keep=COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the similarity of its five-word shingles, 0.8 or more."""
    return drop_near_copies(docs, k=5, num=4, den=5).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the new text."""
    found = scan_secrets(docs, keep=COLUMNS, redacted=True)
    n_chars = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; those that it doesn't take go. Of equal rows, which are interchangeable, each is taken
    alike, and one of them stands for what is left over."""
    keyed = docs.select(*COLUMNS, F.md5(F.to_json(F.struct(*COLUMNS)).cast("binary")).alias("row_key"))
    equal = mix_sources(keyed, keep=("row_key",)).groupBy("row_key").agg(F.count("*").alias("m"), F.sum("copies").alias("copies"))
    equal = table(equal.where("copies > 0").select("row_key", F.floor(F.col("copies") / F.col("m")).alias("each"), (F.col("copies") % F.col("m")).alias("left")))
    alike = keyed.join(equal.where("each > 0"), "row_key").select(*COLUMNS, F.col("each").alias("n"))
    over = keyed.join(equal.where("left > 0"), "row_key").dropDuplicates(["row_key"]).select(*COLUMNS, F.col("left").alias("n"))
    return alike.unionByName(over).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with the hashes of ids and decoded text."""
    return encode_texts(docs, vocabulary())


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("secrets", secrets), ("source_mix", source_mix), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
