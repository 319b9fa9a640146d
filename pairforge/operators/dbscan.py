"""Density clusters over a neighbour graph, and what is left over."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from pairforge.operators.components import KEPT, _roots, connected_components
from pairforge.operators.neighbors import Through, directed
from pairforge.plans.joins import hot_join
from pairforge.plans.scratch import Scratch


#: Up to so many cores and their clusters go to every task, as sorted arrays (16 MB a million).
SHARED = 1_000_000


def _numbers(cores: DataFrame) -> bool:
    return cores.schema["core"].dataType.simpleString() in ("int", "bigint")


def _shared(rows: DataFrame, columns: list[str]) -> Broadcast:
    """Columns of whole numbers, SHARED rows at most, as arrays in the order of the first."""
    table = rows.select(*columns).toArrow()
    arrays = [table.column(c).to_numpy() for c in columns]
    order = np.argsort(arrays[0])
    return rows.sparkSession.sparkContext.broadcast([x[order] for x in arrays])


def _places(known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ids are in sorted known ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return at, known[at] == ids


def among_cores(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """(src, dst): edges(a, b) with a core at both ends; where edges lie, if cores(core) are few enough to be sent to them."""
    edges = edges.where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not _numbers(cores) or cores.count() > SHARED:
        first = hot_join(edges, cores.withColumnRenamed("core", "src"), ["src"])
        return hot_join(first, cores.withColumnRenamed("core", "dst"), ["dst"]).select("src", "dst")
    known = _shared(cores, ["core"])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_places(known.value[0], batch.column(c).to_numpy())[1] for c in ("src", "dst")]
            yield batch.filter(pa.array(both[0] & both[1]))

    kinds = dict(edges.dtypes)
    return edges.where("src is not null and dst is not null").mapInArrow(keep, f"src {kinds['src']}, dst {kinds['dst']}")


def reached(edges: DataFrame, of_core: DataFrame) -> DataFrame:
    """(cluster_id, iso_id), each once: the neighbours of the cores of of_core(core, cluster_id), over edges(a, b). Each batch sends a pair once, and the aggregate's map side leaves one a partition."""
    kind = of_core.schema["cluster_id"].dataType
    few = _numbers(of_core) and kind.simpleString() in ("int", "bigint") and of_core.count() <= SHARED
    if not few:
        from_core = directed(edges).where("src != dst").withColumnRenamed("src", "core")
        return hot_join(from_core, of_core, ["core"]).select("cluster_id", F.col("dst").alias("iso_id")).distinct()
    known = _shared(of_core, ["core", "cluster_id"])
    iso = edges.schema["a"].dataType
    types = [to_arrow_type(kind), to_arrow_type(iso)]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, clusters = known.value
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            (pa_, ina), (pb_, inb) = _places(cores, a), _places(cores, b)
            first = np.concatenate([clusters[pa_[ina]], clusters[pb_[inb]]]) if len(cores) else np.empty(0, np.int64)
            found = pa.table([pa.array(first, types[0]), pa.array(np.concatenate([b[ina], a[inb]]), types[1])], names=["cluster_id", "iso_id"])
            yield from found.group_by(["cluster_id", "iso_id"]).aggregate([]).combine_chunks().to_batches()

    out = edges.where("a != b").select("a", "b").mapInArrow(find, f"cluster_id {kind.simpleString()}, iso_id {iso.simpleString()}")
    return out.groupBy("cluster_id", "iso_id").agg(F.lit(1).alias("_")).drop("_")


def cores_of(edges: DataFrame, min_neighbors: int) -> DataFrame:
    """(core) of edges(a, b), undirected, each once. Both ends of an edge are counted where it lies, so a task sends a row an entity."""
    ends = edges.where("a != b").select(F.explode(F.array("a", "b")).alias("core"))
    return ends.groupBy("core").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_neighbors).select("core")


def once(edges: DataFrame) -> DataFrame:
    """(a, b) of any edge table, a < b, each once; loops and null ends left out."""
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def thinning(iso: DataType, min_neighbors: int) -> Through:
    """Edges (a, b, ...), undirected, each there once -> (a, b, n): what tells the density clusters with min_neighbors neighbours or fewer, made where edges lie, in one pass over them.

    Each partition gives an entity's edges there by their number (b is null), and edges (n is null): those between two entities that have min_neighbors of them there, which are cores for certain, as a
    forest, and all others, of which an entity has fewer than min_neighbors. So rows grow with the entities of a partition, not with its edges, and neither does a task hold more.
    """
    arrow = to_arrow_type(iso)
    text, least = not pa.types.is_integer(arrow), max(1, min_neighbors)
    schema = pa.schema([("a", arrow), ("b", arrow), ("n", pa.int64())])
    none = np.empty(0, object if text else np.int64)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, degree, joined, loose = none, np.empty(0, np.int64), (none, none), (none, none)
        fresh, n, most = [], 0, KEPT

        def settle() -> None:
            nonlocal known, degree, joined, loose
            a, b = (np.concatenate(x) for x in zip(*fresh, strict=True))
            every = np.unique(np.concatenate([known, a, b]))
            counts = np.bincount(np.searchsorted(every, np.concatenate([a, b])), minlength=len(every))
            counts[np.searchsorted(every, known)] += degree
            known, degree = every, counts
            a, b = (np.searchsorted(known, np.concatenate([x, y])) for x, y in zip(loose, (a, b), strict=True))
            sure = (degree[a] >= least) & (degree[b] >= least)
            loose = known[a[~sure]], known[b[~sure]]
            a, b = (np.concatenate([np.searchsorted(known, x), y[sure]]) for x, y in zip(joined, (a, b), strict=True))
            root = _roots(a, b, len(known))
            rest = np.flatnonzero(root != np.arange(len(known)))
            joined = known[root[rest]], known[rest]

        for batch in batches:
            fresh.append(tuple(np.array(batch.column(c).to_pylist(), object) if text else batch.column(c).to_numpy() for c in ("a", "b")))
            n += batch.num_rows
            if n > most:
                settle()
                fresh, n, most = [], 0, max(KEPT, len(known))
        if n:
            settle()
        counted = pa.table([pa.array(known, arrow), pa.nulls(len(known), arrow), pa.array(degree)], schema=schema)
        yield from counted.to_batches(max_chunksize=1 << 16)
        for a, b in (joined, loose):
            yield from pa.table([pa.array(a, arrow), pa.array(b, arrow), pa.nulls(len(a), pa.int64())], schema=schema).to_batches(max_chunksize=1 << 16)

    return task, f"a {iso.simpleString()}, b {iso.simpleString()}, n long"


def thinned(edges: DataFrame, min_neighbors: int) -> DataFrame:
    """thinning of a table of edges(a, b); loops and null ends are left out."""
    task, schema = thinning(edges.schema["a"].dataType, min_neighbors)
    return edges.where("a != b").select("a", "b").mapInArrow(task, schema)


def dbscan(edges: DataFrame, min_neighbors: int, distinct: bool = False) -> DataFrame:
    """edges(a, b), undirected -> (cluster_id, iso_id, is_core). cluster_id is the smallest core of the cluster.

    A core has at least min_neighbors neighbours, itself not counted. A cluster is a component of the graph among cores with all neighbours
    of its cores, so a border entity belongs to every cluster that reaches it, and no visiting order matters.
    distinct: no edge is there twice, either way round, so none needs to be looked for. Edges are then read once, where they lie, and what is shuffled and written grows with the entities of a partition, not with its edges.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.select("a", "b") if distinct else scratch.keep(once(edges))
    return density_clusters(scratch.keep(thinned(edges, min_neighbors)), min_neighbors)


def density_clusters(thin: DataFrame, min_neighbors: int) -> DataFrame:
    """dbscan of the edges that were thinned for so many neighbours or more, from a kept table."""
    scratch = Scratch(thin.sparkSession)
    degrees = thin.where("n is not null").groupBy(F.col("a").alias("core")).agg(F.sum("n").alias("degree"))
    cores = scratch.keep(degrees.where(F.col("degree") >= min_neighbors).select("core"))
    edges = thin.where("n is null").select("a", "b")
    parts = connected_components(among_cores(edges, cores), scratch)
    of_core = scratch.keep(cores.join(parts.withColumnsRenamed({"node": "core", "component": "cluster_id"}), "core", "left").select("core", F.coalesce("cluster_id", "core").alias("cluster_id")))
    members = reached(edges, of_core).unionByName(of_core.select("cluster_id", F.col("core").alias("iso_id"))).distinct()
    return members.join(cores.select(F.col("core").alias("iso_id"), F.lit(True).alias("c")), "iso_id", "left").select("cluster_id", "iso_id", F.coalesce("c", F.lit(False)).alias("is_core"))


def single_link(edges: DataFrame) -> DataFrame:
    """(cluster_id, iso_id): components of two entities or more; cluster_id is the smallest member."""
    parts = connected_components(edges.where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return parts.select(F.col("component").alias("cluster_id"), F.col("node").alias("iso_id"))


def noise(points: DataFrame, membership: DataFrame) -> DataFrame:
    """Entities in no cluster."""
    return points.select("iso_id").join(membership.select("iso_id").distinct(), "iso_id", "left_anti")


def overlaps(membership: DataFrame) -> DataFrame:
    """(iso_id, n_clusters) of entities in more than one cluster."""
    return membership.groupBy("iso_id").agg(F.count_distinct("cluster_id").alias("n_clusters")).where("n_clusters > 1")
