"""From raw documents to packed sequences, each stage written before the next one reads it.

Every stage but the last returns the columns of its documents, extra ones (whatever their names) included.  Null texts and texts without a letter are
of no language and go in the first stage; on their own, the stages treat a null text as one without lines, words or tokens.  A null doc_id sorts last.
Repeated rows share their fate: equal lines and texts stay once (in the lines and near-duplicate stages), or both rows are mixed and packed.  Of ties
the smallest doc_id wins, then the smallest hash of the text.  Very long texts are processed whole.  An empty table gives empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm import langid, linededup, mixing, packing, simhash
from octolith.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence; learnt from their own labels."""
    model = langid.fit(langid.labelled_sample(docs))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return langid.identify(found, model).filter(~F.col("rejected")).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs in earlier documents."""
    return linededup.without_templates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles have a cosine of 0.8 or more with another one's."""
    return simhash.keep_one(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: Language models, components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
