"""From raw documents to packed training sequences: language ID, toxicity, near-duplicates, packing.

Every stage but the last returns rows of its input as they are, with their columns. Null and empty texts, repeated rows and
keys, null keys and empty tables have a defined result in each, said with the stage; columns that are not named are
carried along and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import langid, minhash, packing, toxicity
from verdigris.llm.common import release, remainder, staged, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told, learned from the stage's own input but a fifth.

    Rejected are texts without a letter (null and empty ones too) and those of no clear language. Equal texts fare
    equally, so repeated rows stay or go together. Where no row has a language, every text with a letter stays.
    """
    return langid.keep(docs, langid.fit(docs.filter(remainder("doc_id", 5) != 0)))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below one half for toxicity, learned from the labels of four fifths of the keys.

    Null and empty texts have no word and score what the bias gives. Equal texts fare equally. Labels of keys that the
    input lacks teach nothing; without labels of both kinds every text scores the share of toxic ones.
    """
    marks = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    return toxicity.keep(docs, toxicity.fit(docs, marks))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id (null last), of equal rows one.

    Texts without a word are no copies of each other, but of rows of equal key and text one stays. Where a doc_id has
    several texts, each is kept or dropped on its own.
    """
    return minhash.keep(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents encoded and packed into training sequences; see packing.pack.

    Texts without tokens are listed in rows of length 0; repeated rows and null keys are packed like others.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identified), ("toxicity", harmless), ("near_duplicates", distinct), ("packing", sequences)]

#: Classifiers and signatures have no SQL; tests/llm compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next, and deleted once that is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
