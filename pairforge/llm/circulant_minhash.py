"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A text is cut into words (A-Z in lower case, other than space and 0x09-0x0D); its set holds the distinct runs of five words as 64-bit hashes, or
the whole sequence if it has fewer. Two permutations of the 2^32 places make all COORDINATES of a signature: the first places
the elements, the second, shifted by k places on the circle, gives coordinate k its order. BANDS bands of
ROWS coordinates make buckets; at a similarity of 0.75 a pair meets in none of them with probability (1 - 0.75^4)^32 < 6e-6.

Texts with equal words are one node from the start, however many documents have them. A bucket never emits all its pairs: small ones (at most SMALL nodes) do,
larger ones compare a pivot, the node that meets most others, with the rest. Nodes that this does not bring into their bucket's largest component then meet all
nodes of the bucket's other components in blocks of bounded size, where counts of the elements in PLACES cells, which bound an intersection from
above, rule most pairs out; only the plausible ones become rows. No link between nodes of different components goes unverified. Similarity is exact, on full sets.

Defined cases: a text without words, or null, has an empty set and is its own component; repeated rows are linked; rows without an id
are linked like others, have the least id of their component, null if it has none, and are not kept; very long texts are read whole, and
count exactly up to 2^32 elements in a sketch's cell; other columns of docs do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.tables import BROADCAST_IDS, table, unused
from pairforge.llm.words import hashed, small
from pairforge.operators.components import connected_components
from pairforge.operators.neighbors import block_pairs
from pairforge.plans.joins import hot_join, salted_join
from pairforge.plans.scratch import Scratch

WORDS, COORDINATES, ROWS, SMALL, PLACES = 5, 128, 4, 12, 256
BANDS = COORDINATES // ROWS
PERCENT = 75
#: Pairs of one node that a task takes at most, about.
PAIRS = 4096


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of a text: distinct 64-bit hashes, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = hashed(words)
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += h[i : i + n] * _ODD[i]
    return np.unique(_mix64(total))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: multiplications by odd numbers and xor-shifts can be undone."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]


def signature(elements: np.ndarray, piece: int = 8192) -> np.ndarray:
    placed = _permute((elements ^ (elements >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), piece):
        turned = placed[None, at : at + piece] + _SHIFTS
        np.minimum(best, _permute(turned, 0x21F0AAAD, 0xD35A2D97).min(1), out=best)
    return best


def bands(elements: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = signature(elements).reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64) * _ODD[4]
    for i in range(ROWS):
        total = _mix64(total + rows[:, i] * _ODD[i])
    return total.view(np.int64)


def _cut(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _node(words: list[bytes]) -> bytes:
    """The words' digest; texts with equal words are one node."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        sizes, nodes, keys = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = _cut(text)
            elements = shingles(words)
            sizes.append(len(elements))
            nodes.append(_node(words) if words else None)
            keys.append(bands(elements) if words else None)
        values = np.concatenate([k for k in keys if k is not None]) if any(k is not None for k in keys) else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([BANDS if k is not None else 0 for k in keys])])
        yield pa.record_batch(
            {
                **{c: batch.column(c) for c in batch.schema.names if c != "text"},
                "n": pa.array(sizes, pa.int64()),
                "node": pa.array(nodes, pa.binary()),
                "keys": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
            }
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, elements, sketch) of the rows whose text is the node's."""
    for batch in small(batches):
        nodes, sets, sketches = [], [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = _cut(text)
            if words and _node(words) == node:
                nodes.append(node)
                elements = shingles(words)
                sets.append(elements.view(np.int64))
                sketches.append(np.bincount((elements >> np.uint64(40)).astype(np.int64) % PLACES, minlength=PLACES).astype(np.uint32).tobytes())
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.record_batch({"node": pa.array(nodes, pa.binary()), "elements": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)), "sketch": pa.array(sketches, pa.binary())})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of a kept table that are similar. A pivot's pairs are dealt over partitions, PAIRS of them to each, as all meet whole sets."""
    b = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    a = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    both = hot_join(hot_join(pairs, b, ["b"], hot_rows=PAIRS), a, ["a"], hot_rows=PAIRS, counted=pairs)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = both.withColumn("shared", shared)
    return both.where(100 * F.col("shared") >= PERCENT * (F.size("of_a") + F.size("of_b") - F.col("shared"))).drop("of_a", "of_b", "shared")


def _fits(na: str, nb: str):
    """No pair of such sizes can be similar otherwise."""
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def _sketch_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components whose sketches leave a similarity of PERCENT possible.

    A sketch counts a set's elements in PLACES cells, so the sum of the lesser counts is never under the size of the intersection.
    """
    names = ["a", "b"]
    if not len(left) or not len(right):
        return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
    x, y = (np.stack([np.frombuffer(v, np.uint32) for v in side.sketch]) for side in (left, right))
    n, comp, node = right.n.to_numpy(), right.comp.to_numpy(), right.iso_id.to_numpy()
    out: list[tuple[bytes, bytes]] = []
    for own, size, c, i in zip(x, left.n, left.comp, left.iso_id, strict=True):
        most = np.minimum(y, own).sum(1, dtype=np.int64)
        ok = (100 * most >= PERCENT * (size + n - most)) & (comp != c)
        out += [(min(i, j), max(i, j)) for j in node[ok]]
    return pd.DataFrame(out, columns=names).astype(object)


def links(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """members(key, node, n) -> (src, dst): enough similar pairs to connect whatever similar pairs of a bucket connect."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    state = scratch.keep(salted_join(members, scratch.keep(sizes), ["key"]))
    few, many = state.where(F.col("size") <= SMALL), state.where(F.col("size") > SMALL)
    left, right = [few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n")]) for x in "ab"]
    pairs = left.join(right, "key").where("node_a < node_b").drop("key")
    # The node that meets most others over all its buckets is the middle of a group; all its buckets take it for their pivot.
    scores = scratch.keep(many.groupBy("node").agg(F.sum("size").alias("score")))
    many = scratch.keep(many.select("key", "node", "n").join(scores, "node"))
    pivots = scratch.keep(many.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("p")).select("key", F.col("p.node").alias("node_a"), F.col("p.n").alias("n_a")))
    stars = salted_join(many.select("key", F.col("node").alias("node_b"), F.col("n").alias("n_b")), pivots, ["key"]).where("node_a != node_b").drop("key")
    pairs = pairs.unionByName(stars.select(pairs.columns)).where(_fits("n_a", "n_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    first = scratch.keep(_verified(scratch.keep(pairs), sets))
    # What the pivots have not brought into one component meets the rest of its bucket in blocks of sketches.
    comps = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    many = many.join(comps, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    many = scratch.keep(many)
    parts = many.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"))
    open_keys = scratch.keep(parts.where("comps > 1").select("key", F.col("top.comp").alias("top")))
    rows = salted_join(many, open_keys, ["key"]).join(sets.select("node", "sketch"), "node")
    rows = scratch.keep(rows.select(F.col("key").alias("cell"), F.col("node").alias("iso_id"), "n", "comp", "top", "sketch"))
    plausible = block_pairs(rows.where("comp != top").drop("top"), rows.drop("top"), _sketch_pairs, "a binary, b binary").distinct()
    second = scratch.keep(_verified(scratch.keep(plausible), sets))
    return first.unionByName(second).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(rid, text) join wanted(rid, node); wanted goes to all tasks while it is small."""
    small = wanted.count() <= BROADCAST_IDS
    return docs.select("rid", "text").join(F.broadcast(wanted) if small else wanted.hint("merge"), "rid").select("node", "text")


def _judged(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> (rows without their text, with n and node; nodes with the label and the least id of their component)."""
    # A text is found again by a document's id, or, where it has none, by its hash; its words decide whether it is the one.
    docs = docs.withColumn("rid", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    fields = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    rows = scratch.keep(docs.mapInArrow(_sketch, f"{fields}, n long, node binary, keys array<long>"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    nodes = scratch.keep(nodes)
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = scratch.keep(salted_join(buckets, scratch.keep(shared), ["key"]))
    wanted = members.select("node").distinct().join(nodes.select("node", "rid"), "node").select("rid", "node")
    # Repeated rows of an id give one set.
    sets = scratch.keep(_texts_of(docs, scratch.keep(wanted)).mapInArrow(_full_sets, "node binary, elements array<long>, sketch binary").groupBy("node").agg(F.first("elements").alias("elements"), F.first("sketch").alias("sketch")))
    joined = connected_components(links(members, sets, scratch), scratch)
    ids = joined.join(nodes.select("node", "first_id"), "node")
    least = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    grouped = salted_join(joined, least, ["component"]).select("node", "component", "component_id")
    of_node = nodes.select("node", "first_id").join(grouped, "node", "left")
    # A component of rows without ids has none either.
    alone = F.col("component").isNull()
    of_node = of_node.select("node", F.coalesce("component", "node").alias("label"), F.when(alone, F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.drop("keys", "rid"), scratch.keep(of_node)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row a document."""
    rows, of_node = _judged(docs.select("doc_id", "text"), Scratch(docs.sparkSession))
    out = salted_join(rows, of_node.drop("label"), ["node"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the least id, rows without an id last; of several texts of that id the one
    with the least digest, of equal rows one. Ids may repeat: rows are told apart by id and text. Rows without words all stay."""
    scratch = Scratch(docs.sparkSession)
    (row,) = unused(docs, "row")
    key = F.unhex(F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))))
    rows, of_node = _judged(docs.select("doc_id", "text", key.alias("row")), scratch)
    labelled = scratch.keep(salted_join(rows.where("node is not null").select("doc_id", "row", "node"), of_node.select("node", "label"), ["node"]))
    winners = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("w"))
    winners = scratch.keep(winners.select(F.col("w.row").alias("row")))
    counted = scratch.keep(labelled.groupBy("row").agg(F.count("*").alias("c")))
    gone = scratch.keep(counted.select("row").join(winners, "row", "left_anti").withColumnRenamed("row", row))
    again = scratch.keep(counted.where("c > 1").join(winners, "row", "left_semi").select(F.col("row").alias(row)))

    def listed(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if x.count() <= BROADCAST_IDS else x.hint("merge")

    left = docs.withColumn(row, key).join(listed(gone), row, "left_anti")
    if again.isEmpty():
        return left.select(docs.columns)
    one = left.join(listed(again), row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("of"))
    return left.join(listed(again), row, "left_anti").select(docs.columns).unionByName(one.select("of.*"))


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def sql() -> str:
    """DuckDB SQL by the definition: all pairs of texts that share a shingle, counted, and their closure."""
    run = f"array_to_string(w[i:i + {WORDS - 1}], ' ')"
    return rf"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS MATERIALIZED (SELECT w, min(doc_id) AS node FROM texts WHERE len(w) > 0 GROUP BY w),
sets AS MATERIALIZED (SELECT node, w, CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct([{run} FOR i IN range(1, len(w) - {WORDS - 2})]) END AS s FROM nodes),
items AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS x FROM sets),
linked AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.node, b.node HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, t.doc_id) AS component_id, coalesce(t.doc_id = coalesce(l.component_id, t.doc_id), false) AS kept
FROM texts t LEFT JOIN sets s ON t.w = s.w LEFT JOIN least l ON s.node = l.node
"""
