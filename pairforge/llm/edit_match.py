"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of characters other than letters and digits as one space, and one at each end. An item of n characters, taken with the
space before and after it, so as whole words, may differ from a passage by budget = floor(RATE * n) edits. Cut into budget + 1 pieces, at least one piece of it occurs
unchanged in any passage within the budget; an Aho-Corasick automaton finds all piece hits of a whole document in
one run, and Myers' bit-parallel distance is computed over the stretch that each group of hits allows. The benchmark is sent to the tasks in parts
of at most PART_CHARS characters; a larger one costs more passes, not more memory.

Defined cases: null and empty texts match nothing; items without letters or digits match nothing; items without an id count like others, and matches give their id as null;
very long texts are read whole, and an item longer than PART_CHARS is a part of its own; other columns stay as they are;
repeated items and documents give one row a pair of ids, and so do all documents, or items, whose id is null; ids are cast to long (text that is no number: an error in Spark's
ANSI mode, else null); documents are dropped row by row, whatever their ids; an empty table gives an empty result; of several passages the least distance counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.tables import table
from pairforge.llm.words import small

RATE, PART_CHARS = 0.05, 2_000_000
_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces that differ in length by one at most."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item, ready for Myers' algorithm: Python integers hold the bit columns."""

    def __init__(self, item_id: int | None, item: str):
        self.id, self.text, self.budget = item_id, f" {item} ", int(RATE * len(item))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(self.text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def least_distance(self, passage: str) -> int:
        """The least edit distance between the item and any stretch of the passage."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best = full, 0, m, m
        for c in passage:
            eq = self.masks.get(c, 0)
            across = eq | down
            level = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (full & ~(level | up)), up & level
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            # A passage may begin anywhere, so the row above the first stays zero: nothing is carried in.
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | (full & ~(across | plus)), plus & across
            best = min(best, score)
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.patterns = [Pattern(i, t) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for offset, piece in pieces(p.text, p.budget):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of all items that occur within their budget."""
        starts: dict[int, set[int]] = {}
        text = f" {text} "
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(end + 1 - length - offset)
        out = []
        for k, places in starts.items():
            p, best = self.patterns[k], None
            for first, last in self._groups(sorted(places), 2 * p.budget):
                d = p.least_distance(text[max(0, first - p.budget) : last + len(p.text) + p.budget])
                if d <= p.budget and (best is None or d < best):
                    best = d
            if best is not None:
                out.append((p.id, best))
        return out

    @staticmethod
    def _groups(starts: list[int], reach: int) -> Iterator[tuple[int, int]]:
        """Starts that lie within reach of each other share one verification."""
        first = last = starts[0]
        for s in starts[1:]:
            if s - last > reach:
                yield first, last
                first = s
            last = s
        yield first, last


#: The automaton of the last part that a Python worker saw, by the part's name.
_made: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[int | None, str]]) -> Matcher:
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(items)
    return _made[name]


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n_parts = -(-chars // PART_CHARS)
    for k in range(n_parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k)
        rows = [(r.item_id, plain(r.text)) for r in part.collect()]  # one part, about PART_CHARS
        yield [(i, t) for i, t in rows if t]


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): one row for each document and item that it holds within the item's budget."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int"
    out = spark.createDataFrame([], schema)
    for items in _parts(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def found(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                matcher = _matcher(name, shared.value)
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in matcher.matches(plain(t))] if shared.value else []
                ids, item_ids, distances = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "item_id": pa.array(item_ids, pa.int64()), "distance": pa.array(distances, pa.int32())})

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item. Rows are judged where they lie: no shuffle."""
    names = docs.columns
    at = names.index("text")
    for items in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                matcher = _matcher(name, shared.value)
                keep = [not (t and shared.value and matcher.matches(plain(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_pigeonhole_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
