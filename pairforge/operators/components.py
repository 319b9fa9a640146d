"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairforge.plans.joins import hot_join
from pairforge.plans.scratch import Scratch

#: A task keeps so many edges, besides its forest, before it looks for those that join nothing new.
KEPT = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return root


def forests(edges: DataFrame) -> DataFrame:
    """(src, dst): in each partition of edges(src, dst), every entity but the smallest of its component there, with that smallest one. So as many rows as a partition has entities at most, whatever its
    edges, and the same components. Loops stay, edges with a null end do not."""
    kind = edges.schema["src"].dataType
    arrow = to_arrow_type(kind)
    schema = pa.schema([("src", arrow), ("dst", arrow)])
    text = not pa.types.is_integer(arrow)

    def forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        known, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        loops = np.unique(at[: len(a)][a == b])
        root = _roots(at[: len(a)], at[len(a) :], len(known))
        joined = np.flatnonzero(root != np.arange(len(known)))
        return known[np.concatenate([root[joined], loops])], known[np.concatenate([joined, loops])]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, most = [], 0, KEPT
        for batch in batches:
            sides = [np.array(batch.column(c).to_pylist(), object) if text else batch.column(c).to_numpy() for c in ("src", "dst")]
            pairs, n = [*pairs, tuple(sides)], n + len(sides[0])
            if n > most:
                pairs = [forest(pairs)]
                n = len(pairs[0][0])
                most = max(KEPT, 2 * n)
        if n:
            a, b = forest(pairs)
            yield from pa.table([pa.array(a, arrow), pa.array(b, arrow)], schema=schema).to_batches(max_chunksize=1 << 16)

    name = kind.simpleString()
    return edges.where("src is not null and dst is not null").select("src", "dst").mapInArrow(task, f"src {name}, dst {name}")


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges(src, dst), undirected -> (node, component), component being the smallest node that is reachable.

    A round hooks every node to its smallest neighbour (an aggregate with map-side combine, so a hub
    is no hot task), jumps pointers until all point to roots, and goes on with the edges between
    roots. Nodes at least halve in a round. Roots and ends that many rows share are found by a bounded count and
    dealt over partitions by their number; without such hubs nothing is repeated. Loops (src = dst) make a component of one; rows with a
    null end are left out. Every round cuts its lineage through a scratch table. Partitions send a forest of their edges (forests), so what is shuffled grows with the entities.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = forests(edges)
    left = scratch.keep(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(left.select(F.col("dst").alias("node"), F.col("src").alias("next")))
        roots = scratch.keep(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("root")))
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = scratch.keep(hot_join(roots, up, ["root"]).select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            scratch.forget(roots)
            roots = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        maps.append(roots)
        ends = scratch.keep(hot_join(left, roots.withColumnRenamed("node", "src").withColumnRenamed("root", "a"), ["src"]).select("a", "dst"))
        ends = hot_join(ends, roots.withColumnRenamed("node", "dst").withColumnRenamed("root", "b"), ["dst"])
        after = scratch.keep(ends.where("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        scratch.forget(left)
        left = after
    if not maps:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = scratch.keep(hot_join(earlier, above, ["root"], "left").select("node", F.coalesce("top", "root").alias("root")))
    return found.withColumnRenamed("root", "component")
