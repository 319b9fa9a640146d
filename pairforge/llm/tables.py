"""Reading the corpus tables, and small helpers that all llm operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.plans.joins import salted_join

#: Up to so many rows of numbers a join sends its right side to all tasks (some 20 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 200_000

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def only_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; extra ones, whatever their names, are left out."""
    return docs.select(*[c for c in DOCUMENT_COLUMNS if c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them differ from every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left join right on `on`; right: a kept table of numbers. It goes to all tasks while it is small, else left's hot keys are salted."""
    if right.count() <= BROADCAST_IDS:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how, hint="merge")
