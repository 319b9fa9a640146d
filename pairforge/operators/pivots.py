"""A tree of pivots over vectors of several blocks ("regions"), made level by level as tables.

A node has a centre, and in each region a radius that covers its rows. A node of more than `block` rows is cut into the cells of FANOUT pivots, which a bounded sample of its rows
gives (half of them by chance, so that dense parts are cut too, half farthest-first); cells are cut again until they hold `block` rows or can't be cut,
as copies can't; those are dealt to leaves by a hash. So the number of pivots grows with the rows. The sample decides where the cells lie, not what is found: every row is in a leaf.

Two trees are descended from the pair of their roots: a pair of nodes gives way to the pairs of their children, as long as the triangle inequality lets both hold rows
within the radii of each other. Pairs whose ancestors are far apart are never made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from pairforge.functions.vectors import distance
from pairforge.plans.joins import salted_join
from pairforge.plans.scratch import Scratch

FANOUT, SAMPLE, PART = 16, 512, 8192
#: Up to so many centres go to all tasks, which then place rows where they lie; beyond, rows are sent to their node's centres.
SHARED = 2048
#: Up to so many nodes go to all tasks where pairs of nodes are descended (about 600 bytes each).
SHARED_NODES = 16_384
#: Pairs of nodes whose children a task compares, about.
SPREAD = 64
ROOT = "0"


@dataclass
class PivotTree:
    rows: DataFrame  # the rows given, with leaf
    nodes: DataFrame  # parent, node, center, away (array of a radius a region); leaves are their own parents too
    depth: int


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def regions_of(widths: list[int]) -> list[slice]:
    ends = np.cumsum(widths).tolist()
    return [slice(b - w, b) for w, b in zip(widths, ends, strict=True)]


def distances(x: np.ndarray, center: np.ndarray, parts: list[slice]) -> np.ndarray:
    """One column a region."""
    return np.stack([np.sqrt(((x[:, p] - center[p]) ** 2).sum(1)) for p in parts], 1)


def _centers(x: np.ndarray, parts: list[slice], units: np.ndarray, fanout: int) -> np.ndarray:
    """Rows of a sample as pivots: the first ones of half their number, then those farthest from all chosen."""
    chosen = list(range(min(len(x), -(-fanout // 2))))
    away = np.min([(distances(x, x[i], parts) / units).max(1) for i in chosen], axis=0)
    while len(chosen) < min(fanout, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, (distances(x, x[chosen[-1]], parts) / units).max(1))
    return x[chosen]


def _nearest(x: np.ndarray, centers: np.ndarray, parts: list[slice], units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre in units of the radii, and the distances from it."""
    child, best, away = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), len(parts)))
    for k, c in enumerate(centers):
        d = distances(x, c, parts)
        u = (d / units).max(1)
        nearer = u < best
        child[nearer], best[nearer], away[nearer] = k, u[nearer], d[nearer]
    return child, away


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def build(rows: DataFrame, widths: list[int], radii: list[float], scratch: Scratch, block: int, fanout: int = FANOUT) -> PivotTree:
    """rows(iso_id, v: array of all regions' elements, ...) -> a tree whose leaves hold at most about `block` rows."""
    parts, units = regions_of(widths), np.maximum(np.array(radii, float), 1e-300)
    kinds = dict(rows.dtypes)
    others = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    spark, n = rows.sparkSession, rows.count()
    state = rows.withColumn("node", F.lit(ROOT)).withColumn("n", F.lit(n).cast("long"))
    todo = spark.createDataFrame([(ROOT, n)] if n > block else [], "node string, n long")
    leaves, nodes, n_open = [state.where(F.col("n") <= block).withColumn("leaf", F.col("node"))], [], int(n > block)
    while n_open:
        state = state.where(F.col("n") > block)
        mark = F.pmod(F.xxhash64("iso_id"), F.lit(1 << 30))
        under = state.where(mark.cast("double") * F.col("n") < 1.5 * SAMPLE * (1 << 30))
        sample = under.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(mark, "iso_id"))).where(F.col("r") <= SAMPLE).select("node", "v")

        def choose(t: pa.Table) -> pa.Table:
            return pa.table({"node": t.column("node").slice(0, 1), "centers": pa.array([[c.tolist() for c in _centers(matrix(t.column("v")), parts, units, fanout)]], pa.list_(pa.list_(pa.float64())))})

        chosen = scratch.keep(sample.groupBy("node").applyInArrow(choose, "node string, centers array<array<double>>"))
        schema = f"{others}, node string, n long, child long, away array<double>"

        def put(batch: pa.RecordBatch | pa.Table, centers: np.ndarray) -> list:
            child, away = _nearest(matrix(batch.column("v")), centers, parts, units)
            return [*[batch.column(c) for c in [*kinds, "node", "n"]], pa.array(child), _lists(away)]

        names = [*kinds, "node", "n", "child", "away"]
        if n_open * fanout <= SHARED:
            known = {r.node: np.array(r.centers, float) for r in chosen.collect()}  # SHARED vectors at most

            def place(batches, known=known):
                for batch in batches:
                    node = np.array(batch.column("node").to_pylist(), object)
                    for name in set(node.tolist()):
                        one = batch.filter(pa.array(node == name)) if n_open > 1 else batch
                        yield pa.record_batch(put(one, known[name]), names=names)

            moved = state.mapInArrow(place, schema)
        else:
            cuts = F.ceil(F.col("n") / PART)
            left = state.withColumn("part", F.pmod(F.xxhash64("iso_id"), cuts))
            right = chosen.join(todo, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1))).drop("n")

            def assign(a: pa.Table, b: pa.Table) -> pa.Table:
                if not a.num_rows:
                    return pa.table([pa.array([], f.type) for f in empty], schema=empty)
                return pa.table(put(a, matrix(b.column("centers").combine_chunks().flatten())), names=names)

            empty = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in rows.schema.fields], ("node", pa.string()), ("n", pa.int64()), ("child", pa.int64()), ("away", pa.list_(pa.float64()))])
            moved = left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInArrow(assign, schema)
        name = F.concat_ws("/", "node", F.col("child").cast("string"))
        moved = scratch.keep(moved.withColumns({"parent": F.col("node"), "node": name}))
        most = F.array(*[F.max(F.col("away")[k]).alias(f"a{k}") for k in range(len(parts))])
        sizes = moved.groupBy("parent", "node").agg(F.first("n").alias("above"), F.count("*").alias("n"), most.alias("away"))
        # A cell of copies, or one that took nearly all of its parent, is not cut again but dealt by a hash.
        stuck = (F.col("n") > block) & ((F.array_max("away") == 0) | (F.col("n") > 0.95 * F.col("above")))
        sizes = scratch.keep(sizes.withColumn("dealt", F.when(stuck, F.ceil(F.col("n") / block))))
        made = chosen.select(F.col("node").alias("parent"), F.posexplode("centers").alias("k", "center")).select("parent", F.concat_ws("/", "parent", F.col("k").cast("string")).alias("node"), "center")
        nodes.append(made.join(sizes, ["parent", "node"]).select("parent", "node", "center", "away", "n", "dealt"))
        few = n_open * fanout <= SHARED
        moved, known = moved.drop("n", "away", "child", "parent"), sizes.select("node", "n", "dealt")
        moved = moved.join(F.broadcast(known), "node") if few else salted_join(moved, known, ["node"])
        part = F.concat_ws("#", "node", F.pmod(F.xxhash64(F.lit(1), F.col("iso_id")), F.col("dealt")).cast("string"))
        state, whole = moved.where("dealt is null").drop("dealt"), moved.where(F.col("dealt").isNotNull() | (F.col("n") <= block))
        leaves.append(whole.withColumn("leaf", F.coalesce(part, F.col("node"))).drop("dealt"))
        todo = sizes.where(F.col("dealt").isNull() & (F.col("n") > block)).select("node", "n")
        n_open = todo.count()
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)
    tables = spark.createDataFrame([], "parent string, node string, center array<double>, away array<double>, n long, dealt long")
    for level in nodes:
        tables = tables.unionByName(level)
    tables = scratch.keep(tables)
    hashed = tables.where("dealt is not null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dealt") - 1)))
    hashed = hashed.select(F.col("node").alias("parent"), F.concat_ws("#", "node", F.col("part").cast("string")).alias("node"), "center", "away")
    leaf = tables.where(F.col("dealt").isNull() & (F.col("n") <= block)).select("node", "center", "away").unionByName(hashed.drop("parent"))
    steps = tables.select("parent", "node", "center", "away").unionByName(hashed).unionByName(leaf.select(F.col("node").alias("parent"), "node", "center", "away"))
    return PivotTree(scratch.keep(placed.select(*kinds, "leaf")), scratch.keep(steps), len(nodes) + 1)


def near_leaves(tree: PivotTree, widths: list[int], radii: list[float], scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(la, lb): each unordered pair of leaves that may hold rows within the radii, once, and la = lb; and the pairs that were left after each level."""

    def apart(a: Column, b: Column, k: int, part: slice) -> Column:
        piece = lambda c: F.slice(c, part.start + 1, widths[k])
        return distance(piece(a), piece(b))

    side = lambda x: tree.nodes.select(F.col("parent").alias(f"n{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "center", "away")])
    a, b = side("a"), side("b")
    if tree.nodes.count() <= SHARED_NODES:
        a, b = F.broadcast(a), F.broadcast(b)
    near = F.lit(True)
    for k, (part, r) in enumerate(zip(regions_of(widths), radii, strict=True)):
        near = near & (apart(F.col("center_a"), F.col("center_b"), k, part) - F.col("away_a")[k] - F.col("away_b")[k] <= F.lit(r * (1 + 1e-6) + 1e-6))
    pairs = tree.rows.sparkSession.createDataFrame([(ROOT, ROOT)], "na string, nb string")
    if not tree.depth - 1:
        return pairs.toDF("la", "lb"), []
    levels, wide = [], int(tree.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(tree.depth):
        # Pairs all stem from one row, so they would stay in its partition.
        both = pairs.repartition(min(wide, -(-pairs.count() // SPREAD))).join(a, "na").join(b, "nb").where((F.col("na") != F.col("nb")) | (F.col("node_a") <= F.col("node_b")))
        pairs = scratch.keep(both.where(near | (F.col("node_a") == F.col("node_b"))).select(F.col("node_a").alias("na"), F.col("node_b").alias("nb")))
        levels.append(pairs)
    return pairs.toDF("la", "lb"), levels
