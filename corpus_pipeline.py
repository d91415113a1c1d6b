"""Corpus preparation: five stages over ``documents``, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, langid, lines, minhash, mixing
from latticework.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def once(docs: DataFrame) -> DataFrame:
    """One row of those with equal id and text. Its grouping starts with the id, so a join on the id before it needs no second shuffle."""
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("__h"), F.xxhash64(F.lit(7), "text").alias("__g"))
    one = named.groupBy("doc_id", "__h", "__g").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("r"))
    return one.select("doc_id", "r.*").select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (a text that is null, empty or has no letter); those kept carry the predicted one.

    Each row is judged by its own text, so rows with a null id, several texts under one id and repeated
    rows stay as they are. Where nothing can be learned (no row has a text and a language), documents with
    letters are kept with the language that they have. An empty table stays empty; texts are read whole,
    however long. Columns other than COLUMNS are left out.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    told = langid.identify_rows(docs.select(COLUMNS), model)
    return told.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines common to many documents; a document of which only blanks are left goes, unless it had no such line.

    Rows with one id count as one document, rows with a null id lose nothing; repeated rows all stay. A null text stays
    as an empty one. Columns other than COLUMNS are left out.
    """
    out = lines.drop_common_lines(docs.select(COLUMNS)).where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(lines.BLANKS))) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates (five-word shingles, 0.8): the one with the smallest id.

    Of rows with one id and text one stays, of several texts under the kept id all stay. Rows with a null id cannot be named
    in a class, so all their different texts are kept. Texts without a word link with nothing.
    Columns other than COLUMNS are left out.
    """
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"))
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__id"), "left_semi")
    return once(named).unionByName(once(docs.where("doc_id is null")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that their sources reach the mixed weights; no document is lost.

    A null source counts as one source of its own, null ids of a source as one document, and so do several texts under one id:
    they are repeated together. A document without words has one pass. Columns other than COLUMNS are left out.
    """
    return mixing.mixed_rows(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document that training reads, and whether they decode to its text.

    The passes of a document come one after the other, and equal texts of a batch are encoded once. A null text is
    encoded as an empty one; texts are read whole. Rows with a null id and repeated rows have their row each.
    """
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near", dedup_near),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL cannot express the language machines, the band search or the encoder; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
