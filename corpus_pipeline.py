"""From raw documents to token ids, in five stages; each works on all that the one before it kept.

Documents are told apart by ``doc_id``. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs`` as they came, extra ones included, and has the executors give back the heap that the one before it took. ``run`` writes what each stage returns to the shared folder and reads it
again, so that a lost executor costs one stage's work at most; what the stage before returned is deleted then.

Defined results: null text counts as empty in every stage. Rows with a null key are kept by the near-copy stage and told apart by
nothing but their text elsewhere. Repeated rows are exact copies, and one of them stays. Of all empty texts one stays, too. An empty
table gives an empty result. Extra columns pass through, whatever their names; ids go to ``ids``, or where ``docs`` has such a column to
``ids_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lenticule.llm import bpe, decontaminate, exact_dedup, near_copies, toxicity
from lenticule.llm.common import discard, fresh_path, give_back, intermediates, table
from lenticule.llm.registry import BPE_VOCABULARY, TOXIC_FROM, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    give_back(spark)
    return toxicity.keep_below(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest doc_id."""
    give_back(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the five-word shingles), the document with the smallest doc_id."""
    give_back(spark)
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    give_back(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their tokens."""
    give_back(spark)
    taken, name = {c.lower() for c in docs.columns}, "ids"
    while name in taken:
        name += "_"
    return bpe.encode_documents(docs, vocabulary=BPE_VOCABULARY, ids=name)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Training, components and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "_"))
        with intermediates(spark):  # what operators wrote on the way goes once the stage's result is there
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
