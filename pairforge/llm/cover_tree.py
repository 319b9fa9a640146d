"""Exact top-k search by inner product with one cover tree of queries and data.

The tree is built level by level as tables. A node has a centre and a covering radius. Of a node with more than NODE rows, farthest-first centres
are chosen, the node's own first, until half its radius covers the node's rows of a sample (SAMPLE a node) or there are BRANCH; rows within half the
radius of a centre go to the nearest one's child, so radii halve at least from level to level, and rows that no centre reaches
are children of their own, with radius 0. The sample decides where centres lie, not what is found: every row is in the tree.
A node's children of their own, and the rows of a node with NODE or fewer, are dealt to blocks, at most about NODE rows or QUERY_NODE queries each.

The search starts with the pair of roots and replaces pairs by the pairs of their children, level by level, for all queries at once. A pair
is skipped if no product can reach the query node's worst kth score: centre . centre' + |centre| radius' + |centre'| radius +
radius radius' < worst. Worst scores come from a bounded sample of rows, then from each query block's own cell. Pairs of blocks that are
left go to tasks, where a row's bound is its product itself: one matrix product a pair.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; nor do rows without an id; vectors meet those of their own
length only; ids may repeat: every row is a candidate, for other rows of its id too, and every query row gives results; scores beyond 64 bits become
the largest or smallest long; equal scores rank by smaller id;
fewer than k candidates give fewer rows; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.llm.tables import table
from pairforge.plans.joins import salted_join
from pairforge.plans.scratch import Scratch

K, SAMPLE, BRANCH, NODE, QUERY_NODE, PART, SALTS = 5, 1024, 32, 1024, 512, 8192, 32


def integral(vector: Column) -> Column:
    """floor(256 x) of every component, kept as doubles; null where a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer products. Doubles hold them while they stay under 2^53."""
    if q.size and d.size and np.abs(q).max() * np.abs(d).max() * q.shape[1] >= 2**53:
        whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in d], object).T
        return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)
    return (q @ d.T).astype(np.int64)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in v]).reshape(len(v), -1)


def _distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - center) ** 2).sum(1))


def _chosen(sample: pd.DataFrame) -> pd.DataFrame:
    """The centres of a node's children, and how far they reach. Without a centre yet, the row nearest to the mean is the root's."""
    x, radius, center = _matrix(sample.v), sample.radius.iloc[0], sample.center.iloc[0]
    if center is None:
        centers, reach = [x[_distances(x, x.mean(0)).argmin()]], np.inf
    else:
        centers, reach = [np.asarray(center, float)], radius / 2
        away = _distances(x, centers[0])
        while away.max() > reach and len(centers) < BRANCH:
            centers.append(x[away.argmax()])
            away = np.minimum(away, _distances(x, centers[-1]))
    return pd.DataFrame({"node": [sample.node.iloc[0]], "centers": [[c.tolist() for c in centers]], "reach": [reach]})


def _assigned(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """rows with the child that covers them (null: a child of its own) and the distance from its centre, else from the node's."""
    if not len(rows):
        return rows[["rid", "vec_id", "v", "asked", "node"]].assign(child=pd.Series([], dtype="float"), away=pd.Series([], dtype="float"))
    x, reach = _matrix(rows.v), chosen.reach.iloc[0]
    first = nearest = None
    for i, c in enumerate(chosen.centers.iloc[0]):
        d = _distances(x, np.asarray(c, float))
        if nearest is None:
            first, nearest, child = d, d.copy(), np.zeros(len(x))
        else:
            child[d < nearest] = i
            nearest = np.minimum(nearest, d)
    child = np.where(nearest <= reach, child, np.nan)
    return rows[["rid", "vec_id", "v", "asked", "node"]].assign(child=child, away=np.where(np.isnan(child), first, nearest))


def _sampled(rows: DataFrame, by: str | None = None) -> DataFrame:
    """SAMPLE rows at most of each group with n rows, the first by a hash. Only rows under a bar that leaves somewhat more than these meet in one task."""
    mark = F.pmod(F.xxhash64("rid"), F.lit(1 << 30))
    under = rows.where(mark.cast("double") * F.col("n") < 1.25 * SAMPLE * (1 << 30))
    if by is None:
        return under.orderBy(mark, "rid").limit(SAMPLE)
    return under.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(mark, "rid"))).where(F.col("r") <= SAMPLE)


ROW = "rid long, vec_id long, v array<double>, asked boolean"


def build(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows(rid, vec_id, v, asked) -> (rows with their cell and their distance from its centre, cells(cell, parent, center, radius))."""
    none = F.lit(None)
    state = rows.withColumn("node", F.size("v").cast("string")).withColumns({"n": F.lit(rows.count()).cast("long"), "radius": none.cast("double")})
    info = state.select("node").distinct().select("node", none.cast("array<double>").alias("center"))
    placed, cells = [], []
    while not state.isEmpty():
        sample = _sampled(state, "node").join(info, "node")
        chosen = scratch.keep(sample.groupBy("node").applyInPandas(_chosen, "node string, centers array<array<double>>, reach double"))
        # A node's rows are dealt over tasks; its centres, BRANCH at most, go to each.
        parts = F.ceil(F.col("n") / PART)
        left = state.withColumn("part", F.pmod(F.xxhash64("rid"), parts))
        right = chosen.join(state.select("node", parts.alias("parts")).distinct(), "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        moved = left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInPandas(_assigned, f"{ROW}, node string, child double, away double")
        moved = scratch.keep(moved)
        placed.append(moved.where("child is null").drop("child").withColumnRenamed("node", "cell"))
        child = F.concat_ws("/", "node", F.col("child").cast("int").cast("string"))
        inner = moved.where("child is not null").withColumn("node", child).drop("child")
        sizes = scratch.keep(inner.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("radius")))
        made = chosen.select("node", F.posexplode("centers").alias("child", "center")).select(F.concat_ws("/", "node", "child").alias("cell"), F.col("node").alias("parent"), "center")
        made = scratch.keep(made.join(sizes.select(F.col("node").alias("cell"), "radius"), "cell"))
        cells.append(made)
        inner = scratch.keep(salted_join(inner, sizes, ["node"]))
        open_ = (F.col("n") > NODE) & (F.col("radius") > 0)
        placed.append(inner.where(~open_).drop("n", "radius").withColumnRenamed("node", "cell"))
        state = inner.where(open_).drop("away")
        info = made.select(F.col("cell").alias("node"), "center")
    empty = rows.where("false").select("rid", "vec_id", "v", "asked", F.lit("").alias("cell"), F.lit(0.0).alias("away"))
    no_cells = rows.where("false").select(F.lit("").alias("cell"), F.lit("").alias("parent"), F.col("v").alias("center"), F.lit(0.0).alias("radius"))
    return functools.reduce(DataFrame.unionByName, placed, empty), functools.reduce(DataFrame.unionByName, cells, no_cells)


@dataclass
class Tree:
    rows: DataFrame  # rid, vec_id, v, asked, d_block, q_block
    nodes: DataFrame  # cell, parent, center, radius
    d_blocks: DataFrame  # block, cell, center, radius, n
    q_blocks: DataFrame
    depth: int


def tree_of(rows: DataFrame, scratch: Scratch) -> Tree:
    placed, cells = build(rows, scratch)
    cells = scratch.keep(cells)
    sizes = scratch.keep(placed.groupBy("cell").agg(F.ceil(F.count("*") / NODE).alias("d_parts"), F.greatest(F.lit(1), F.ceil(F.count_if("asked") / QUERY_NODE)).alias("q_parts")))
    block = lambda parts, seed: F.concat_ws("#", "cell", F.pmod(F.xxhash64(F.lit(seed), F.col("rid")), F.col(parts)).cast("string"))
    placed = scratch.keep(salted_join(placed, sizes, ["cell"]).withColumn("d_block", block("d_parts", "d")).withColumn("q_block", F.when(F.col("asked"), block("q_parts", "q"))).drop("d_parts", "q_parts"))

    def blocks(name: str) -> DataFrame:
        made = placed.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("block"), "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        return scratch.keep(made.join(cells.select("cell", "center"), "cell"))

    depth = cells.agg(F.max(F.size(F.split("cell", "/"))).alias("d")).first().d or 0
    return Tree(placed, cells, blocks("d_block"), blocks("q_block"), depth)


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """pairs(q, d) of blocks: each query's best rows in each pair, if they reach its floor. A task gets two blocks, whose sizes are bounded."""
    names = ["query", "query_id", "vec_id", "score"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series([], dtype="int64") for n in names})
        scores, floors = products(_matrix(left.v), _matrix(right.v)), left.floor.to_numpy(float)
        own, ids = left.rid.to_numpy(), right.vec_id.to_numpy()
        # What can enter a query's best: its k highest here besides itself, ties included, if they reach what it has.
        enough = np.maximum(np.partition(scores, -k - 1, axis=1)[:, -k - 1], floors) if scores.shape[1] > k else floors
        i, j = np.nonzero((scores >= enough[:, None]) & (own[:, None] != right.rid.to_numpy()[None]))
        order = np.lexsort((ids[j], -scores[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pd.DataFrame({"query": own[i], "query_id": left.vec_id.to_numpy()[i], "vec_id": ids[j], "score": scores[i, j]})

    q = queries.select(F.col("q_block").alias("q"), "rid", "vec_id", "v", "floor").join(pairs, "q")
    d = data.select(F.col("d_block").alias("d"), "rid", "vec_id", "v").join(pairs, "d")
    return q.groupBy("q", "d").cogroup(d.groupBy("q", "d")).applyInPandas(search, "query long, query_id long, vec_id long, score long")


def _with_floors(rows: DataFrame, k: int) -> DataFrame:
    """The query rows with floor, the kth score that they reach in a sample of SAMPLE rows."""
    some = _sampled(rows.withColumn("n", F.lit(rows.count()))).select("rid", "v").collect()
    by_length = {n: (np.array([r.v for r in some if len(r.v) == n]).reshape(-1, n), np.array([r.rid for r in some if len(r.v) == n])) for n in {len(r.v) for r in some}}
    shared = rows.sparkSession.sparkContext.broadcast(by_length)  # SAMPLE vectors
    schema = f"{ROW}, q_block string, floor double"

    def floors(batches):
        for pdf in batches:
            out = np.full(len(pdf), -np.inf)
            lengths = pdf.v.map(len).to_numpy()
            for n in np.unique(lengths):
                x, ids = shared.value.get(int(n), (np.empty((0, n)), np.empty(0)))
                at = np.flatnonzero(lengths == n)
                if len(x) > k:
                    scores = products(_matrix(pdf.v.iloc[at]), x).astype(float)
                    scores[pdf.rid.to_numpy()[at][:, None] == ids[None]] = -np.inf
                    out[at] = np.partition(scores, -k, axis=1)[:, -k]
            yield pdf.assign(floor=out)

    return rows.where("asked").select("rid", "vec_id", "v", "asked", "q_block").mapInPandas(floors, schema)


def surviving_pairs(tree: Tree, floors: DataFrame, scratch: Scratch) -> DataFrame:
    """(q, d): pairs of blocks that may hold a score at or over the worst of the query block. floors(q_block, floor)."""
    worst = scratch.keep(floors.groupBy(F.col("q_block").alias("block")).agg(F.min("floor").alias("worst")))
    q_blocks = tree.q_blocks.join(worst, "block")
    parts = F.split("cell", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    of_cell = q_blocks.select(F.explode(above).alias("cell"), "worst").groupBy("cell").agg(F.min("worst").alias("worst"))
    q_nodes = tree.nodes.join(of_cell, "cell")
    side = lambda df, *more: df.select(F.col(df.columns[0]).alias("at"), F.col(df.columns[1]).alias("next"), "center", "radius", *more)

    def steps(nodes: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
        """(at, next): from a node to its children and blocks, from a block to itself."""
        cols = ["center", "radius", *more]
        return side(nodes.select("parent", "cell", *cols), *more).unionByName(side(blocks.select("cell", "block", *cols), *more)).unionByName(side(blocks.select("block", F.col("block").alias("same"), *cols), *more))

    q = scratch.keep(steps(q_nodes, q_blocks, "worst").select(F.col("at").alias("q"), F.col("next").alias("q2"), F.col("center").alias("qc"), F.col("radius").alias("qr"), "worst"))
    d = scratch.keep(steps(tree.nodes, tree.d_blocks).select(F.col("at").alias("d"), F.col("next").alias("d2"), F.col("center").alias("dc"), F.col("radius").alias("dr")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    bound = dot("qc", "dc") + norm("qc") * F.col("dr") + norm("dc") * F.col("qr") + F.col("qr") * F.col("dr")
    roots = F.instr("cell", "/") == F.length("parent") + 1
    pairs = q_nodes.where(roots & ~F.contains("parent", F.lit("/"))).select(F.col("cell").alias("q"), F.col("cell").alias("d"))
    for _ in range(tree.depth):
        both = salted_join(salted_join(pairs, q, ["q"], salts=SALTS), d, ["d"], salts=SALTS)
        pairs = scratch.keep(both.where(bound + 1e-9 * (1 + F.abs(bound)) >= F.col("worst")).select(F.col("q2").alias("q"), F.col("d2").alias("d")))
    return pairs


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """vectors(vec_id, v: array<double> of whole numbers) -> query_id, rank, vec_id, score."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long"), "v", F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "v", "asked"))
    tree = tree_of(rows, scratch)
    asked = scratch.keep(_with_floors(tree.rows, k))
    # First each query block meets a block of its own cell.
    seeds = scratch.keep(tree.q_blocks.select(F.col("block").alias("q"), "cell").join(tree.d_blocks.groupBy("cell").agg(F.min("block").alias("d")), "cell").select("q", "d"))
    seeded = scratch.keep(_searched(seeds, asked, tree.rows, k))
    kth = seeded.groupBy("query").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("c")).where(F.col("c") == k).select(F.col("query").alias("rid"), "kth")
    asked = scratch.keep(asked.join(kth, "rid", "left").select("rid", "vec_id", "v", "asked", "q_block", F.greatest("floor", F.coalesce("kth", F.lit(float("-inf")))).alias("floor")))
    rest = scratch.keep(surviving_pairs(tree, asked.select("q_block", "floor"), scratch).join(seeds, ["q", "d"], "left_anti"))
    found = seeded.unionByName(_searched(rest, asked, tree.rows, k))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integral(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % 50 == 0)


def sql() -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON d.rid <> q.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
