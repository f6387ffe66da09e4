"""A corpus pipeline of five stages; every stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import curriculum, langmix, packing, simhash, toxicity
from pageloom.llm.common import stored, table
from pageloom.llm.tokens import vocabulary

# In every stage rows without a doc_id and repeated rows are rows like any other, an empty
# table gives no rows, and further columns, whatever their names, are kept but in the last.


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic; null and empty texts stay."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that fills at least half of them, so null texts
    and texts without a letter too."""
    return langmix.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component, over shingles of five words and
    with a similarity of 0.8: that with the smallest id, rows without one last.  Rows with
    one id stay unless their texts are near; null and wordless texts are one component."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents to meet their source's target, in training order; a null
    source is one of its own, null and wordless texts are never taken."""
    return curriculum.training_order(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences of 2048; null and empty texts are one
    end id, and a document is packed as often as it occurs."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), "byte", 1)


STAGES = [("toxicity", toxic), ("language", language), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing_sequences)]

#: Trained models, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
