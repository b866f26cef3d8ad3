"""The corpus pipeline: what a training run reads, from raw documents to packed sequences.

``STAGES`` are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of documents. Labels are read from ``sf_dir``; each stage works on all that its predecessor kept.

Cases, in every stage: a null text is an empty one; the quality rules reject texts without words. Rows without an id
are scored and packed like others, teach the classifier nothing and are nobody's copy. Repeated rows of an id are one
document and stay or go together; of near copies the smallest id stays. Further columns pass through as they are,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_copies, packing, quality, toxicity
from tidemark.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labelled ones among ``docs``."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality.filter_documents(docs, "v1")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more; candidates by SimHash, verified exactly) the document
    of the smallest id stays."""
    return near_copies.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 tokens, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), separator=1)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("simhash near-dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: A classifier's fit, components and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
