"""A corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), calls one operator of tidemark.llm and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents, and
none minds what further columns are called. Rows with equal ids and texts are judged alike; empty tables give
empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, lines, packing, toxicity
from tidemark.llm.common import row_key, same, stored, table

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC_FROM, by a lexicon learned from the labels of these documents.

    Null and empty texts stay; without labels everything does. Each repeated row is judged by its own text.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs, lexicon, F.col("text")) < TOXIC_FROM).select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its lines that many documents share; n_chars is that of the new text. Null texts become empty."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Texts without words all stay.

    Rows with equal ids and texts are one document.
    """
    found = stored(jaccard.near_duplicates(docs, with_row=True), "near-duplicates")
    key = [F.col("doc_id").alias("_id"), F.col("row").alias("_key")]
    keyed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), row_key(F.col("text")).alias("_key"))
    both = ["_id", "_key"]  # rows with a null id are all kept, and match nothing here
    kept = keyed.join(found.filter(~F.col("kept")).select(key).distinct(), both, "left_anti")
    repeated = found.groupBy(key).count().filter("count > 1").select(both)
    if repeated.limit(1).count():
        once = kept.join(repeated, both, "left_anti")
        kept = once.unionByName(kept.join(repeated, both, "left_semi").withColumn("_text", F.col("_doc.text")).dropDuplicates(["_id", "_text"]).drop("_text"))
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts stay; rows with a null id are judged like others."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), proximity=None, with_row=True)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("_hid"), F.col("row").alias("_hit")).distinct()
    keyed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), row_key(F.col("text")).alias("_key"))
    kept = keyed.join(hit, same(F.col("_id"), F.col("_hid")) & (F.col("_key") == F.col("_hit")), "left_anti")
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 1024 tokens.

    Null and empty texts are one piece, the end token; repeated rows are documents of their own.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return packing.pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A learned lexicon, tokenization and best-fit packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
