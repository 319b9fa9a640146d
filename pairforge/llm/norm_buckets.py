"""Ranked lexical search over buckets of documents by the length of their impact vectors.

A document's impact vector has, at each of the items' terms that it holds, (10^9 tf) div (1000 tf + 12 m); an item's vector has each term's weight times its
occurrences. A score is their inner product. Documents are ranged by the length of their vectors, longest first, in partitions by range, and cut into buckets of
BUCKET documents. An item skips a bucket, and all later ones of the partition, if its own length times the bucket's largest is below the worst of its
best scores so far (Cauchy-Schwarz). Inside a bucket its heaviest coordinates are added up, and documents are left out whose sum, with the lengths of what is
left on both sides, stays below (the coordinate bound). Survivors are scored again in 64-bit integers. The worst of the best scores starts from the
SEED longest documents, which the driver's job scores first, and rises within each task.

A pass over whole texts counts terms and makes the vectors, which hold the items' terms only; later steps read these. Items go to the tasks in parts of at most PART_CHARS characters; more items cost more
passes, not more memory. A task sends at most k documents an item on. Bounds are taken in doubles with a margin of a billionth.

Defined cases: null and empty texts have no terms and are not counted; items with null or empty texts get no rows; each row of the items is an item of its own, whatever its id, and each row of
documents a document of its own; null ids come after all others of the same score; very long texts are read whole; other columns do not matter; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.llm.tables import table
from pairforge.llm.words import small, words
from pairforge.plans.scratch import Scratch

K, BUCKET, SEED, PART_CHARS, FOCUS = 20, 4096, 4096, 2_000_000, 8
MARGIN = 1e-9
#: Documents without an id come last.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Query:
    """An item: the places of its terms in the vocabulary, heaviest first, and their weights times occurrences."""

    number: int
    places: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.length = math.sqrt(float((self.weights.astype(float) ** 2).sum()))
        self.rest = math.sqrt(float((self.weights[FOCUS:].astype(float) ** 2).sum()))


class Bucket:
    """Documents of about one length, as postings by term."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(places, kind="stable")
        self.ids, self.n, self.longest, self.squares = ids, len(ids), float(lengths.max(initial=0)), lengths**2
        self.doc, self.impact = doc[order], impacts[order]
        self.terms, self.starts = np.unique(places[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(order))

    def _postings(self, places: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        at = np.minimum(np.searchsorted(self.terms, places), max(len(self.terms) - 1, 0))
        for i in np.flatnonzero(self.terms[at] == places) if len(self.terms) else ():
            a, b = self.starts[at[i]], self.stops[at[i]]
            yield self.doc[a:b], self.impact[a:b], int(weights[i])

    def best(self, q: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, exact scores) of all documents with scores above 0 and of `least` or more."""
        part, squares = np.zeros(self.n), np.zeros(self.n)
        for doc, impact, weight in self._postings(q.places[:FOCUS], q.weights[:FOCUS]):
            part[doc] += impact * float(weight)
            squares[doc] += impact.astype(float) ** 2
        bound = part + q.rest * np.sqrt(np.maximum(self.squares * (1 + MARGIN) - squares, 0))
        alive = (bound * (1 + MARGIN) >= least) & (bound > 0)
        score = np.zeros(self.n, np.int64)
        if alive.any():
            for doc, impact, weight in self._postings(q.places, q.weights):
                kept = alive[doc]
                score[doc[kept]] += impact[kept] * weight
        found = np.flatnonzero(alive & (score >= max(least, 1)))
        return found, score[found]


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.heaps = floors.copy(), k, [[] for _ in floors]

    def search(self, bucket: Bucket, queries: list[Query]) -> list[Query]:
        """Adds a bucket's documents; returns the items that later, shorter, buckets may still matter to."""
        left = []
        for q in queries:
            if q.length * bucket.longest * (1 + MARGIN) < max(self.floors[q.number], 1):
                continue
            left.append(q)
            found, scores = bucket.best(q, int(self.floors[q.number]))
            heap = self.heaps[q.number]
            # By rank, so that equal scores go to smaller ids; the worst one is the heap's top.
            for i in np.lexsort((bucket.ids[found], -scores))[: self.k]:
                entry = (int(scores[i]), -int(bucket.ids[found[i]]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floors[q.number] = max(self.floors[q.number], heap[0][0])
        return left

    def rows(self) -> pd.DataFrame:
        made = [(n, -i, s) for n, heap in enumerate(self.heaps) for s, i in heap]
        return pd.DataFrame(made, columns=["item", "doc_id", "score"]).astype({"item": "int32", "doc_id": "int64", "score": "int64"})


def _parts(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """The items as (id, terms), in parts of about PART_CHARS characters."""
    items = items.where("text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = -(-chars // PART_CHARS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # one part
        yield [(r.item_id, c) for r in rows if (c := Counter(words(r.text.encode("utf-8", "replace"))))]


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, places, tfs): the number of all terms, and how often the vocabulary's occur, of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        for batch in small(batches):
            ids, ns, places, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                if found:
                    held = Counter(filter(place.__contains__, found))
                    ids.append(doc_id)
                    ns.append(len(found))
                    places.append([place[w] for w in held])
                    tfs.append(list(held.values()))
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()), "places": pa.array(places, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(count, "doc_id long, n long, places array<int>, tfs array<long>")


def impacts(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, length, places, impacts) of counted documents that hold a term of the items."""
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    vector = F.transform("tfs", lambda tf: F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(12).cast("long") * F.col("m")))
    made = rows.where(F.size("places") > 0).withColumn("m", m.cast("long")).select("doc_id", "places", vector.alias("impacts"))
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return made.select("doc_id", length.alias("length"), "places", "impacts")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BUCKET):
            held.append(batch.slice(at, BUCKET))
            rows += held[-1].num_rows
            while rows >= BUCKET:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield _bucket(whole.slice(0, BUCKET))
                held, rows = [whole.slice(BUCKET)], whole.num_rows - BUCKET
    if rows:
        yield _bucket(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _bucket(batch: pa.RecordBatch) -> Bucket:
    places = batch.column("places")
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    sizes = np.diff(places.offsets.to_numpy())
    return Bucket(ids, batch.column("length").to_numpy(zero_copy_only=False), sizes, places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("impacts").flatten().to_numpy(zero_copy_only=False))


def top_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank from 1, doc_id, score): each item's k best documents with scores above 0, equal scores by doc_id."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = dict(items.dtypes)["item_id"]
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for part in _parts(items):
        vocabulary = sorted(set().union(*[c for _, c in part]))
        if not vocabulary:
            continue
        rows = scratch.keep(counted(docs, vocabulary))
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        held = {r.place: r.df for r in rows.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df")).collect()}  # a row a term of the part
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i, w in enumerate(vocabulary)}
        place = {w: i for i, w in enumerate(vocabulary)}
        queries = []
        for number, (_, c) in enumerate(part):
            found = sorted(((weight[w] * times, place[w]) for w, times in c.items()), reverse=True)
            queries.append(Query(number, np.array([p for _, p in found], np.int64), np.array([x for x, _ in found], np.int64)))
        vectors = scratch.keep(impacts(rows, n_docs, n_terms).repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length")))
        model = spark.sparkContext.broadcast(queries)

        def search(floors: np.ndarray, model=model):
            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best, left = Best(floors, k), model.value
                for bucket in _buckets(batches):
                    left = best.search(bucket, left)
                    if not left:
                        break
                yield pa.RecordBatch.from_pandas(best.rows(), preserve_index=False)

            return task

        found = "item int, doc_id long, score long"
        # The longest documents of all first: any k of them give a floor.
        longest = vectors.orderBy(F.desc("length")).limit(SEED).coalesce(1).mapInArrow(search(np.zeros(len(queries), np.int64)), found)
        floors = np.zeros(len(queries), np.int64)
        for r in longest.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():  # a row an item
            floors[r.item] = r.least if r.n >= k else 0
        pool = vectors.mapInArrow(search(floors), found)
        ranked = pool.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(part)], f"item int, item_id {kind}")
        doc_id = F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id"))
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score"))  # a row an item
    return out


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def sql(k: int = K) -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # The text without capitals makes runs of what is left after them, so the class may leave capitals in.
    terms = lambda x: f"unnest(regexp_extract_all(translate({x}, '{capitals}', '{capitals.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, {terms("text")} AS term FROM d) GROUP BY r, term),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM size),
m AS (SELECT r, 100 - 25 + ((25 * n * docs) // l) AS m FROM size, whole),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
qt AS (SELECT q, term, count(*) AS times FROM (SELECT q, {terms("text")} AS term FROM i) GROUP BY q, term),
scores AS (SELECT q, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores JOIN i USING (q) JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
