"""Hashed words of whole texts, for Arrow batches inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.tables import fold

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    """Letters A-Z in lower case; any byte over 127 counts as a letter."""
    return WORD.findall((text or b"").lower())


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hashed(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash a word. Hashing is faster than a lookup in a table of words seen, and needs no memory."""
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def bucketed(found: list[bytes], size: int) -> np.ndarray:
    return (hashed(found) % np.uint64(size)).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, learn: list[int], per_class: int) -> DataFrame:
    """(text, y): at most per_class rows of each class, the first by a hash of the id, from the folds in `learn` alone.

    Ids without a label or text are left out; an id with several labels has the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(fold(F.col("doc_id"), folds).isin(learn))
    known = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = some[0].unionByName(some[1])  # at most 2 * per_class ids, so a broadcast is bounded
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y")
