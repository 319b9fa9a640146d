"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixing, sharding.

Each stage works on all documents that the one before it kept, and takes (spark, docs, sf_dir). All but the last return
the columns of documents; the last adds size, text_crc32, law, shard, slot and grown_shard. Stages are written as Parquet
and reread, so none recomputes another.

Defined cases: null and empty texts are scored by the classifier like others (without words, by their structure alone), are linked with nothing, hold no benchmark item and weigh nothing in mixing; null and
repeated ids stay as they are, as every stage judges rows; equal texts are one group of near-duplicates, of which the row with the smallest id stays; very long texts are read whole; columns other than those of
documents are left out, whatever their names; without labels, or with labels of one class, nothing is rejected for its quality unless all labels say so; without benchmark items nothing is dropped for them;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import circulant_minhash, edit_match, hash_tree, quality_fm, soft_mixing
from pairforge.llm.tables import only_documents, table
from pairforge.plans.scratch import Scratch

#: Shares of the tokens that the mixed corpus aims at. No document's rate goes below 1, so mixing repeats and drops nothing.
MIX = {"en": 0.52, "de": 0.17, "fr": 0.17, "es": 0.14}
SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = only_documents(docs)
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score_quality(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return circulant_minhash.drop_near_duplicates(only_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return edit_match.drop_contaminated(only_documents(docs), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates."""
    docs = only_documents(docs)
    mixed = soft_mixing.mix(docs, table(spark, sf_dir, "labels"), MIX, least=1.0, cover=True)
    return soft_mixing.repeated(mixed).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hash_tree.shard(only_documents(docs), hash_tree.tree_of(SHARDS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The quality and mixing stages hold fitted models, which SQL can't express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
