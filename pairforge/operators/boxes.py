"""Range queries over boxes of median planes.

Points are cut at the medians of PLANES projections at a time, of the dimensions that vary most with each other (dims.split_planes), until a cell holds `block` points; a cell's bounding box has
a low and a high corner in each region, and boxes merge upwards into a tree. Queries fall into the same cells; cells that follow each other make blocks of about QUERY_BLOCK queries, with boxes of their own.
Blocks of queries descend the tree: a box that is farther away in some region than its radius is left out with all that lies in it, and one whose farthest corner is within
all radii of the whole block is taken as it is. Of what is left, each query meets each box by its own point: it leaves the box out, takes it whole, or has its points compared.
Only the last costs products. Boxes and blocks are bundled, a SIDES-th of the rows or MOST rows at most, and a task gets a bundle of each, every row once; so a row is sent to as many tasks as there
are bundles of the other side, and no table of queries and boxes is made. Medians decide where boxes lie, not what is found, so they are approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairforge.functions.vectors import projection
from pairforge.operators.dims import split_planes
from pairforge.operators.neighbors import MOST, SENT, SIDES, _by_task, within
from pairforge.operators.pivots import matrix, regions_of
from pairforge.plans.joins import salted_join
from pairforge.plans.ranks import running_sums
from pairforge.plans.scratch import Scratch

BLOCK, PLANES, DIMS_A_PLANE, QUERY_BLOCK = 512, 3, 8, 512
#: Points that a block of queries meets in one product, about.
TILE = 4096
#: Up to so many cells their medians go to all tasks (some 2 MB).
SHARED = 50_000
ROOT = "0"


@dataclass
class BoxTree:
    rows: DataFrame  # iso_id, v, box: of the points
    asked: DataFrame  # iso_id, v, block: of the queries
    nodes: DataFrame  # parent, box, low, high; a leaf is its own parent too
    blocks: DataFrame  # block, low, high
    depth: int


def _corners(group: str):
    def corners(t: pa.Table) -> pa.Table:
        low, high = (matrix(t.column(c)) for c in (("low", "high") if "low" in t.column_names else ("v", "v")))
        return pa.table({group: t.column(group).slice(0, 1), "low": pa.array([low.min(0)], pa.list_(pa.float64())), "high": pa.array([high.max(0)], pa.list_(pa.float64()))})

    return corners


def planes_of(points: DataFrame, regions: list[str], widths: list[int], dims_a_plane: int = DIMS_A_PLANE) -> list[tuple[int, list[int], list[float]]]:
    """(region's number, dimensions, coefficients), the first round of every region first. points(iso_id, z: array of a vector a region)."""
    profiles = points.select("iso_id", F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.col("z")[k].alias("z")) for k, r in enumerate(regions)])).alias("p")).select("iso_id", "p.*")
    rows = split_planes(profiles, dims_a_plane).where("coefficient is not null").orderBy("round", "region", "rank").collect()  # a row a dimension at most
    out: dict[tuple, list] = {}
    for r in rows:
        out.setdefault((r["round"], r.region), []).append((r.dim, r.coefficient))
    return [(regions.index(region), [d for d, _ in found], [c for _, c in found]) for (_, region), found in sorted(out.items())]


def build(points: DataFrame, queries: DataFrame, regions: list[str], widths: list[int], scratch: Scratch, block: int = BLOCK) -> BoxTree:
    """points, queries(iso_id, z: array of a vector a region)."""
    planes = planes_of(points, regions, widths)
    heights = F.array(*[projection(F.col("z")[k], dims, c) for k, dims, c in planes]) if planes else F.array().cast("array<double>")
    both = points.select("iso_id", "z", F.lit(True).alias("held")).unionByName(queries.select("iso_id", "z", F.lit(False).alias("held")))
    both = scratch.keep(both.select("iso_id", F.flatten("z").alias("v"), "held", heights.alias("p")))
    n = both.where("held").count()
    state = both.select("iso_id", "held", "p", F.lit(ROOT).alias("box"), F.lit(n).cast("long").alias("n"), F.lit(0).alias("idle"), F.lit(False).alias("dealt"))
    done, turn = [], 0
    while True:
        open_ = (F.col("n") > block) & ~F.col("dealt")
        done.append(state.where(~open_).drop("p", "idle"))
        state = state.where(open_)
        use = [(PLANES * turn + i) % len(planes) for i in range(min(PLANES, len(planes)))] if planes else []
        cuts = scratch.keep(state.where("held").groupBy("box").agg(F.first("n").alias("n"), *[F.percentile_approx(F.col("p")[i], 0.5).alias(f"m{i}") for i in use]))
        n_open = cuts.count()
        if not n_open:
            break
        side = reduce(lambda a, b: a + b, [F.when(F.col("p")[i] > F.col(f"m{i}"), 2**k).otherwise(0) for k, i in enumerate(use)], F.lit(0))
        few = n_open <= SHARED
        medians = cuts.drop("n")
        cut = state.join(F.broadcast(medians), "box") if few else salted_join(state, medians, ["box"])
        cut = scratch.keep(cut.select("iso_id", "held", "p", F.col("n").alias("above"), "idle", F.concat_ws("/", "box", side.cast("string")).alias("box")))
        sizes = scratch.keep(cut.groupBy("box").agg(F.count_if("held").alias("n")))
        cut = cut.join(F.broadcast(sizes), "box") if few else salted_join(cut, sizes, ["box"])  # 2^PLANES boxes a cell at most
        # Points that no plane tells apart are copies as far as boxes go; they are dealt by a hash.
        idle = F.when(F.col("n") == F.col("above"), F.col("idle") + 1).otherwise(0)
        state = cut.withColumn("idle", idle).withColumn("dealt", F.col("idle") * F.lit(max(len(use), 1)) >= len(planes)).drop("above")
        turn += 1
    placed = reduce(DataFrame.unionByName, done)
    part = F.concat_ws("#", "box", F.pmod(F.xxhash64("iso_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / block))).cast("string"))
    placed = scratch.keep(placed.select("iso_id", "held", F.col("box").alias("cell"), part.alias("box")))
    vectors = both.select("iso_id", "held", "v")
    rows = scratch.keep(placed.where("held").join(vectors.where("held").drop("held"), "iso_id").select("iso_id", "v", "box"))
    level = scratch.keep(rows.groupBy("box").applyInArrow(_corners("box"), "box string, low array<double>, high array<double>"))
    nodes = [level.withColumn("parent", F.col("box"))]
    waiting = level.withColumn("parent", F.substring_index("box", "#", 1))
    # From the deepest cells upwards; a box merges those of its cells, 2^PLANES or the parts of one cell.
    for depth in range(turn, -1, -1):
        here = F.size(F.split("parent", "/")) - 1 == depth
        nodes.append(waiting.where(here))
        merged = waiting.where(here).groupBy("parent").applyInArrow(_corners("parent"), "parent string, low array<double>, high array<double>").withColumnRenamed("parent", "box")
        above = F.when(F.contains("box", F.lit("/")), F.regexp_replace("box", "/[^/]*$", "")).otherwise(F.lit(""))
        waiting = scratch.keep(waiting.where(~here).unionByName(merged.withColumn("parent", above)))
    nodes.append(waiting)
    tree = scratch.keep(reduce(DataFrame.unionByName, [t.select("parent", "box", "low", "high") for t in nodes]))
    counts = placed.where("not held").groupBy("cell").agg(F.count("*").alias("n"))
    homes = running_sums(counts, [], ["cell"], {"upto": "n"}, scratch)
    homes = homes.select("cell", F.floor((F.col("upto") - F.col("n")) / QUERY_BLOCK).alias("start"), F.ceil(F.col("n") / QUERY_BLOCK).alias("parts"))
    asked = salted_join(placed.where("not held").select("iso_id", "cell"), homes, ["cell"])
    asked = asked.select("iso_id", F.concat_ws("#", F.col("start").cast("string"), F.pmod(F.xxhash64("iso_id"), F.col("parts")).cast("string")).alias("block"))
    asked = scratch.keep(asked.join(vectors.where("not held").drop("held"), "iso_id"))
    blocks = scratch.keep(asked.groupBy("block").applyInArrow(_corners("block"), "block string, low array<double>, high array<double>"))
    return BoxTree(rows, asked, tree, blocks, turn + 2)


def _piece(c: str, part: slice) -> Column:
    return F.slice(c, part.start + 1, part.stop - part.start)


def _every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _apart(low: str, high: str, low2: str, high2: str, part: slice) -> tuple[Column, Column]:
    """The least and the largest distance between points of two boxes in a region."""
    a, b, c, d = (_piece(x, part) for x in (low, high, low2, high2))
    total = lambda xs: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x))
    gap = F.zip_with(F.zip_with(c, b, lambda x, y: x - y), F.zip_with(a, d, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    reach = F.zip_with(F.zip_with(d, a, lambda x, y: x - y), F.zip_with(b, c, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return total(gap), total(reach)


def met_blocks(tree: BoxTree, widths: list[int], radii: list[float], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((block, box) that a whole block of queries takes as they are; (block, box) of the leaves that are left to its single queries)."""
    parts = regions_of(widths)
    far, close = _limits(radii)
    boxes = tree.nodes.select(F.col("parent").alias("at"), F.col("box").alias("next"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    bounds = [_apart("low", "high", "l2", "h2", p) for p in parts]
    pairs = tree.blocks.select("block", F.lit("").alias("at"), F.lit(False).alias("inside"))
    for _ in range(tree.depth):
        met = pairs.where("not inside").repartition("block").join(boxes, "at").join(tree.blocks, "block").where(_every([near <= r for (near, _), r in zip(bounds, far, strict=True)]))
        met = met.select("block", F.col("next").alias("at"), _every([reach <= r for (_, reach), r in zip(bounds, close, strict=True)]).alias("inside"))
        pairs = scratch.keep(met.unionByName(pairs.where("inside")))
    pairs = pairs.withColumnRenamed("at", "box")
    return pairs.where("inside").select("block", "box"), pairs.where("not inside").select("block", "box")


def _limits(radii: list[float]) -> tuple[list[float], list[float]]:
    """Distances beyond which boxes are left out, and up to which they are taken: near a radius the products decide."""
    return [r * (1 + 1e-6) + 1e-6 for r in radii], [r * (1 - 1e-9) for r in radii]


@dataclass
class _Met:
    """Queries of a block and some boxes, in a task."""

    x: np.ndarray
    queries: np.ndarray
    y: np.ndarray
    points: np.ndarray
    names: list[str]
    box: np.ndarray  # the box of a point, by its place in names
    inside: np.ndarray  # a row a query, a column a box: taken whole
    open: np.ndarray  # likewise: to be compared


def _bundles(rows: DataFrame, name: str, least: int, scratch: Scratch) -> DataFrame:
    """(name, bundle): leaves or blocks that follow each other, a SIDES-th of the rows together, least at least and MOST at most."""
    counts = scratch.keep(rows.groupBy(name).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    size = min(MOST, max(least, -(-total // SIDES)))
    return scratch.keep(running_sums(counts, [], [name], {"upto": "n"}, scratch).select(name, F.floor((F.col("upto") - F.col("n")) / size).alias("bundle")))


def _met_in_tasks(tree: BoxTree, left: DataFrame, widths: list[int], radii: list[float], work: Callable[[_Met], pa.Table], schema: str, scratch: Scratch) -> DataFrame:
    """work(queries and boxes) for all pairs of left(block, box), in tasks that get bundles of both."""
    parts = regions_of(widths)
    far, close = _limits(radii)
    text = dict(tree.rows.dtypes)["iso_id"] == "string"
    homes = _bundles(tree.rows, "box", BLOCK, scratch), _bundles(tree.asked, "block", QUERY_BLOCK, scratch)
    placed = left.join(homes[0].withColumnRenamed("bundle", "pb"), "box").join(homes[1].withColumnRenamed("bundle", "pa"), "block")
    marks = scratch.keep(placed.groupBy("pa", "pb", F.col("block").alias("name")).agg(F.collect_list("box").alias("wants")))
    sent = marks.select("pa", "pb", F.explode("wants").alias("name")).distinct()
    side = lambda rows, of, asked: rows.select("iso_id", "v", F.col(of).alias("name"), F.lit(asked).alias("asked"))
    rows = side(tree.rows, "box", False).join(sent, "name").unionByName(side(tree.asked, "block", True).join(marks.select("pa", "pb", "name"), "name"))
    rows = rows.select("pa", "pb", "asked", "name", "iso_id", "v", F.lit(None).cast("array<string>").alias("wants"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("iso_id", "v")]
    rows = rows.unionByName(marks.select("pa", "pb", F.lit(True).alias("asked"), "name", *none, "wants"))
    n = marks.select("pa", "pb").distinct().count()

    def cut(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Rows sorted by name: their vectors, ids, the names, and where each begins."""
        names = table.column("name").combine_chunks().dictionary_encode()
        starts = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1))
        iso = table.column("iso_id")
        return matrix(table.column("v")), np.array(iso.to_pylist(), object) if text else iso.to_numpy(), names.dictionary.to_pylist(), starts

    def met(table: pa.Table) -> Iterator[_Met]:
        mark = pc.is_valid(table.column("wants"))
        marks, held = table.filter(mark), table.filter(pc.invert(mark))
        x, queries, blocks, first = cut(held.filter(held.column("asked")))
        y, points, boxes, starts = cut(held.filter(pc.invert(held.column("asked"))))
        ends, rows_of = np.append(starts[1:], len(y)), dict(zip(blocks, zip(first, np.append(first[1:], len(x)), strict=True), strict=True))
        low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
        at = {b: i for i, b in enumerate(boxes)}
        for block, wants in zip(marks.column("name").to_pylist(), marks.column("wants").to_pylist(), strict=True):
            s, e = rows_of[block]
            wanted = np.sort([at[b] for b in wants])
            turns = np.cumsum(ends[wanted] - starts[wanted]) // TILE
            for turn in np.unique(turns):
                w = wanted[turns == turn]
                near, inside = (np.ones((e - s, len(w)), bool) for _ in range(2))
                for p, f, c in zip(parts, far, close, strict=True):
                    q, a, b = x[s:e, None, p], low[None, w, p], high[None, w, p]
                    near &= np.sqrt((np.maximum(np.maximum(a - q, q - b), 0.0) ** 2).sum(2)) <= f
                    inside &= np.sqrt((np.maximum(np.abs(q - a), np.abs(q - b)) ** 2).sum(2)) <= c
                rows = np.concatenate([np.arange(starts[i], ends[i]) for i in w])
                yield _Met(x[s:e], queries[s:e], y[rows], points[rows], [boxes[i] for i in w], np.repeat(np.arange(len(w)), ends[w] - starts[w]), near & inside, near & ~inside)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for table in _by_task(batches):
            for one in met(table):
                found = work(one)
                kept, n = [*kept, found] if found.num_rows else kept, n + found.num_rows
                if n >= SENT:
                    yield from pa.concat_tables(kept).combine_chunks().to_batches(max_chunksize=SENT)
                    kept, n = [], 0
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches(max_chunksize=SENT)

    return rows.repartition(max(1, n), "pa", "pb").sortWithinPartitions("pa", "pb", "asked", "name").mapInArrow(task, schema)


def met_boxes(tree: BoxTree, widths: list[int], radii: list[float], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((block, box) that a whole block of queries takes as they are; (iso_id, box, inside) of the boxes that are left to single queries: taken, or to be compared)."""
    whole, left = met_blocks(tree, widths, radii, scratch)
    kind = to_arrow_type(tree.rows.schema["iso_id"].dataType)

    def boxes(m: _Met) -> pa.Table:
        i, k = np.nonzero(m.inside | m.open)
        return pa.table({"iso_id": pa.array(m.queries[i], kind), "box": pa.array([m.names[b] for b in k], pa.string()), "inside": pa.array(m.inside[i, k])})

    name = dict(tree.rows.dtypes)["iso_id"]
    return whole, scratch.keep(_met_in_tasks(tree, left, widths, radii, boxes, f"iso_id {name}, box string, inside boolean", scratch))


def within_range(points: DataFrame, queries: DataFrame, regions: list[str], widths: list[int], radii: list[float], block: int = BLOCK) -> DataFrame:
    """points, queries(iso_id, z: array of a vector a region) -> (query_id, iso_id): all other points within the radius of each region, radii included."""
    scratch = Scratch(points.sparkSession)
    tree = build(points, queries, regions, widths, scratch, block)
    whole, left = met_blocks(tree, widths, radii, scratch)
    # A box that a block takes may be an inner one: its leaves are those whose path goes through it.
    cells = tree.rows.select("iso_id", "box").withColumn("path", F.split(F.substring_index("box", "#", 1), "/"))
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.concat_ws("/", F.slice("path", 1, i)))
    held = cells.select("iso_id", F.explode(F.array_append(above, F.col("box"))).alias("box"))
    taken = salted_join(whole, tree.asked.select(F.col("iso_id").alias("query_id"), "block"), ["block"]).select("query_id", "box")
    taken = salted_join(taken, held.join(whole.select("box").distinct(), "box", "left_semi"), ["box"])
    found = taken.select("query_id", "iso_id").where("query_id != iso_id")
    parts, kind, name = regions_of(widths), to_arrow_type(tree.rows.schema["iso_id"].dataType), dict(tree.rows.dtypes)["iso_id"]

    def pairs(m: _Met) -> pa.Table:
        some, rows = np.flatnonzero(m.open.any(1)), np.flatnonzero(m.open.any(0)[m.box])
        i, j = within([m.x[some][:, p] for p in parts], [m.y[rows][:, p] for p in parts], radii)
        i, j = some[i], rows[j]
        compared = m.open[i, m.box[j]]
        query, point = np.nonzero(m.inside[:, m.box])
        a, b = (np.concatenate(t) for t in ((m.queries[i[compared]], m.queries[query]), (m.points[j[compared]], m.points[point])))
        other = a != b
        return pa.table({"query_id": pa.array(a[other], kind), "iso_id": pa.array(b[other], kind)})

    return found.unionByName(_met_in_tasks(tree, left, widths, radii, pairs, f"query_id {name}, iso_id {name}", scratch))
