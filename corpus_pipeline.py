"""documents to packed training ids: toxicity, near duplicates, leaked benchmark items, mix, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontamination, mixing, ngram_join, token_output, toxicity
from pageloom.llm.common import small_batches, stored, table


#: Words that a worker's encoder remembers; less than alone, as the workers and executors here hold other stages' memory too.
REMEMBERED = 80_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on their labels, doesn't call toxic."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return toxicity.without(docs, chain, "toxic")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked texts, one row of it; texts without words all stay."""
    groups = stored(ngram_join.ngram_groups(docs), "groups")
    gone = stored(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stored(groups.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away no benchmark item."""
    with small_batches(spark):
        found = stored(decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots, with slot and place; those of sources that are short of their weight come again."""
    slots = mixing.schedule(docs, carry=True)
    return slots.repartitionByRange("slot").sortWithinPartitions("slot", "place").select(*(F.col(f"row.{c}").alias(c) for c in docs.columns), "slot", "place")


def packed_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every draw in the order of the mix, read back from the packed files."""
    return token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"), order=("slot", "place"), remembered=REMEMBERED)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("token_output", packed_ids),
]

#: SQL can't run the classifier, the tiling and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept, each stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
