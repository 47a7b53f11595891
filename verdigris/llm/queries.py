"""The queries opN_<name> over the tables of a folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import jaccard, licenses, quantize, undo, warc
from verdigris.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    from verdigris.llm import langid

    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    got = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return got.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "error")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded with the word-level vocabulary."""
    import public_tokenizers

    from verdigris.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours found of every twentieth vector."""
    from verdigris.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    from verdigris.llm import minhash

    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses named or quoted in every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), notices=licenses.NOTICES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and packed into sequences of the permitted lengths."""
    import public_tokenizers

    from verdigris.llm import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a backoff model of six sevenths of them."""
    from verdigris.llm import katz

    return katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    from verdigris.llm import imatch

    return imatch.against_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    from verdigris.llm import toxicity

    return toxicity.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks of integers that all of them have fitted."""
    return quantize.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by links of nine tenths of the three-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of a transaction log: the states of the store, and what was undone by what."""
    return undo.digest(undo.as_log(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "toxic")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_ann": op4_ann,
    "op5_minhash": op5_minhash,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_katz": op8_katz,
    "op9_imatch": op9_imatch,
    "op10_toxicity": op10_toxicity,
    "op11_codes": op11_codes,
    "op12_join": op12_join,
    "op13_undo": op13_undo,
}

ORACLES: dict[str, str] = {"op2_warc": warc.oracle(), "op6_licenses": licenses.oracle(), "op11_codes": quantize.oracle(), "op12_join": jaccard.oracle(), "op13_undo": undo.oracle()}
