"""Exact similarity joins of multi-block vectors.

A tree of pivots (pivots.py) cuts the entities into leaves of BLOCK rows at most; pairs of its nodes are descended and left out by the triangle inequality. Leaves that follow each other
in the tree make a bundle of a SIDES-th of the rows, MOST at most. A task gets the leaves of two bundles that have pairs left, each row once, and computes one matrix product a region for every
pair of leaves, the later regions only for pairs that the earlier ones left. So a row is sent to as many tasks as there are bundles at most, whatever the number of leaves. A cell that holds a
third of all rows is cut into many leaves, not one large task. Tasks stream what they find.

Products are made in single precision, for a leaf and all leaves that it meets in the task. By the bound of their rounding they tell pairs for certain, out or in; the few between are compared by their differences, in doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairforge.operators.pivots import PivotTree, build, matrix, near_leaves, regions_of
from pairforge.plans.ranks import running_sums
from pairforge.plans.scratch import Scratch

BLOCK = 1024
#: A bundle of leaves has a SIDES-th of the rows, and BLOCK at least, MOST at most (17 MB of 64 elements each).
SIDES, MOST = 12, 32_768
#: Pairs that a task sends on at once, about.
SENT = 65_536
#: A later region's product is made for all pairs while more than one of PRODUCT is left; else the pairs that are left are computed one by one.
PRODUCT = 32
#: A leaf meets others together, about so many of their rows at once.
TILE = 4096
#: Rows of both sides of one product, whose results stay in a core's cache.
ROWS, COLUMNS = 256, 1024
#: Leaves meet others together while so large a share of the pairs of rows is wanted.
MORE = 0.8


#: A function of a task's batches, and the schema of what it makes of them.
Through = tuple[Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def block_pairs(home: DataFrame, visitors: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """work(home rows, visitor rows) for every pair of sub-blocks with equal `cell`. Both sides have columns cell and iso_id."""
    sizes = home.groupBy("cell").agg(F.count("*").alias("h")).join(visitors.groupBy("cell").agg(F.count("*").alias("v")), "cell")
    parts = sizes.select("cell", F.ceil(F.col("h") / block).alias("h"), F.ceil(F.col("v") / block).alias("v"))
    own = lambda n: F.pmod(F.xxhash64("iso_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = home.join(parts, "cell").withColumn("si", own("h")).withColumn("sj", each("v")).drop("h", "v")
    right = visitors.join(parts, "cell").withColumn("sj", own("v")).withColumn("si", each("h")).drop("h", "v")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own where both sides are one table
    key = ["cell", "si", "sj"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: work(a, b), schema)


@dataclass
class _Ready:
    """Rows of one region, made ready for products: |x - y| <= radius says that xy - yy / 2, the product of x's left and y's right, is (xx - radius²) / 2 at least. A product below least is beyond the radius for
    certain, one over sure within it; what is between is slack over the rounding of single precision, or of doubles where numbers are too large or small for it."""

    x: np.ndarray
    left: np.ndarray
    right: np.ndarray
    least: np.ndarray
    sure: np.ndarray

    def of(self, rows: slice | np.ndarray) -> _Ready:
        return _Ready(self.x[rows], self.left[rows], self.right[rows], self.least[rows], self.sure[rows])


def _ready(x: np.ndarray, radius: float) -> _Ready:
    """Both sides of a product have to be made ready together."""
    squares = np.einsum("ij,ij->i", x, x)
    most = max(squares[np.isfinite(squares)].max(initial=0.0), radius**2)
    kind, n = np.float32 if 1e-30 < most < 1e30 else np.float64, x.shape[1]
    left, right = np.ones((len(x), n + 1), kind), np.empty((len(x), n + 1), kind)
    left[:, :n], right[:, :n], right[:, n] = x, x, -squares / 2
    least, slack = (squares - radius**2) / 2, 2 * (n + 4) * np.finfo(kind).eps * most
    return _Ready(x, left, right, (least - slack).astype(kind)[:, None], (least + 2 * slack).astype(kind))


def _flat(near: np.ndarray, n: int) -> np.ndarray:
    """Where the first n of flags are set, of which most are not: looked for by eights. Those that fill the last eight are cleared."""
    near[n : -(-n // 8) * 8] = False
    some = np.flatnonzero(near[: -(-n // 8) * 8].view(np.uint64))
    word, place = np.nonzero(near[: -(-n // 8) * 8].reshape(-1, 8)[some])
    return some[word] * 8 + place


def within(a: list[np.ndarray], b: list[np.ndarray], radii: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of pairs within the radius in every region, radii included."""
    with np.errstate(invalid="ignore", over="ignore"):
        both = [_ready(np.concatenate([x, y]), radius) for x, y, radius in zip(a, b, radii, strict=True)]
    n = len(a[0])
    i, j = _near([r.of(slice(0, n)) for r in both], [r.of(slice(n, None)) for r in both], radii)
    order = np.lexsort((j, i))
    return i[order], j[order]


def _near(a: list[_Ready], b: list[_Ready], radii: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """within() of regions that are ready, in any order."""
    rows, columns, places = len(a[0].x), len(b[0].x), ROWS * COLUMNS
    found = [np.empty((2, 0), np.int64)]
    products = [np.empty(places, x.left.dtype) for x in a]
    near, also = np.empty(places, bool), np.empty(places, bool)
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(0, rows, ROWS):
            for j in range(0, columns, COLUMNS):
                h, w = min(ROWS, rows - i), min(COLUMNS, columns - j)
                n, made = h * w, 0
                for k, (x, y) in enumerate(zip(a, b, strict=True)):
                    if made and np.count_nonzero(near[:n]) * PRODUCT <= n:
                        break
                    product, flags = products[k][:n].reshape(h, w), (also if made else near)[:n].reshape(h, w)
                    np.matmul(x.left[i : i + h], y.right[j : j + w].T, out=product)
                    np.greater_equal(product, x.least[i : i + h], out=flags)
                    if made:
                        np.logical_and(near[:n], also[:n], out=near[:n])
                    made += 1
                at = _flat(near, n)
                if len(at):
                    p, q = np.divmod(at, w)
                    p, q = p + i, q + j
                    certain = np.full(len(at), made == len(a))
                    for k in range(made):
                        certain &= products[k][at] > a[k].sure[p]
                    keep = [np.flatnonzero(certain)]
                    rest = np.flatnonzero(~certain)
                    for start in range(0, len(rest), SENT):
                        some = rest[start : start + SENT]
                        for x, y, radius in zip(a, b, radii, strict=True):
                            some = some[np.sqrt(((x.x[p[some]] - y.x[q[some]]) ** 2).sum(1)) <= radius]
                        keep.append(some)
                    some = np.concatenate(keep)
                    found.append(np.stack([p[some], q[some]]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def similar_pairs(points: DataFrame, queries: DataFrame | None, radii: list[float], sizes: list[int], block: int = BLOCK, distances: bool = False, similarities: bool = True, through: Through | None = None) -> DataFrame:
    """points(iso_id, z: array of a vector a region), sizes: the vectors' lengths -> (a, b, pearson: array of a value a region), with distances also distance, likewise; without similarities no pearson.

    Without queries: unordered pairs, a < b. With queries(iso_id, z): a is the query, b any other entity within the radii.
    through: what the tasks make of their pairs, where these are too many to be sent on.
    """
    kind, once = dict(points.dtypes)["iso_id"], queries is None
    values = [*(["pearson"] if similarities else []), *(["distance"] if distances else [])]
    schema = ", ".join([f"a {kind}", f"b {kind}", *[f"{c} array<double>" for c in values]])
    scratch = Scratch(points.sparkSession)
    rows = points.select("iso_id", F.flatten("z").alias("v"), F.lit(True).alias("held"), F.lit(once).alias("asked"))
    if not once:
        rows = rows.unionByName(queries.select("iso_id", F.flatten("z").alias("v"), F.lit(False).alias("held"), F.lit(True).alias("asked")))
    tree = build(scratch.keep(rows), sizes, radii, scratch, block)
    pairs, _ = near_leaves(tree, sizes, radii, scratch)
    parts = regions_of(sizes)
    arrow = pa.schema([("a", to_arrow_type(points.schema["iso_id"].dataType)), ("b", to_arrow_type(points.schema["iso_id"].dataType)), *[(c, pa.list_(pa.float64())) for c in values]])

    def rows_of(own: np.ndarray, other: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.Table:
        a, b = own[p], other[q]
        if once:
            a, b = np.where(a < b, a, b), np.where(a < b, b, a)
        of = {
            "pearson": lambda s, n: (x[p][:, s] * y[q][:, s]).sum(1) / n,
            "distance": lambda s, n: np.sqrt(((x[p][:, s] - y[q][:, s]) ** 2).sum(1)),
        }
        found = [np.stack([of[c](s, n) for s, n in zip(parts, sizes, strict=True)], 1) for c in values]
        lists = [pa.ListArray.from_arrays(np.arange(len(r) + 1, dtype=np.int32) * len(parts), r.ravel()) for r in found]
        return pa.table([pa.array(a, arrow.field("a").type), pa.array(b, arrow.field("b").type), *lists], schema=arrow)

    def work(left: _Leaf, right: _Leaf, same: bool) -> Iterator[pa.Table]:
        x, y, own, other = left.x, right.x, left.iso, right.iso
        i, j = _near(left.ready, right.ready, radii)
        if once:
            keep = own[i] < other[j] if same else own[i] != other[j]
            turns = [(own, other, x, y, i[keep], j[keep])]
        else:
            first = left.asked[i] & right.held[j] & (own[i] != other[j])
            second = right.asked[j] & left.held[i] & (own[i] != other[j])
            # Pairs of one leaf come both ways round as they are.
            turns = [(own, other, x, y, i[first], j[first])] + ([] if same else [(other, own, y, x, j[second], i[second])])
        for *sides, p, q in turns:
            for s in range(0, len(p), SENT):
                yield rows_of(*sides, p[s : s + SENT], q[s : s + SENT])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for table in _by_task(batches):
            for meeting in _meetings(table, kind == "string", parts, radii):
                for found in work(*meeting):
                    kept, n = [*kept, found], n + found.num_rows
                    if n >= SENT:
                        yield from pa.concat_tables(kept).combine_chunks().to_batches(max_chunksize=SENT)
                        kept, n = [], 0
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches(max_chunksize=SENT)

    dealt = tasks(tree, pairs, scratch, block)
    return dealt.mapInArrow(task, schema) if through is None else dealt.mapInArrow(lambda batches: through[0](task(batches)), through[1])


def tasks(tree: PivotTree, pairs: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """The tree's rows with (pa, pb), a pair of bundles of leaves, for each that has a pair (la, lb) of leaves with the row's, dealt and sorted by it; and a row without iso_id for each first leaf, with the second leaves it `wants`."""
    counts = scratch.keep(tree.rows.groupBy("leaf").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    size = min(MOST, max(block, -(-total // SIDES)))
    homes = running_sums(counts, [], ["leaf"], {"upto": "n"}, scratch).select("leaf", F.floor((F.col("upto") - F.col("n")) / size).alias("bundle"))
    homes = scratch.keep(homes)
    placed = pairs.join(homes.select(F.col("leaf").alias("la"), F.col("bundle").alias("ba")), "la").join(homes.select(F.col("leaf").alias("lb"), F.col("bundle").alias("bb")), "lb")
    placed = placed.select("la", "lb", F.least("ba", "bb").alias("pa"), F.greatest("ba", "bb").alias("pb"))
    marks = scratch.keep(placed.groupBy("pa", "pb", F.col("la").alias("leaf")).agg(F.collect_list("lb").alias("wants")))
    sent = marks.select("pa", "pb", "leaf").unionByName(marks.select("pa", "pb", F.explode("wants").alias("leaf"))).distinct()
    none = [c for c in tree.rows.columns if c != "leaf"]
    rows = tree.rows.join(sent, "leaf").select("pa", "pb", "leaf", *none, F.lit(None).cast("array<string>").alias("wants"))
    marks = marks.select("pa", "pb", "leaf", *[F.lit(None).cast(tree.rows.schema[c].dataType).alias(c) for c in none], "wants")
    sides = -(-total // size) + 1
    return rows.unionByName(marks).repartition(sides * (sides + 1) // 2, "pa", "pb").sortWithinPartitions("pa", "pb", "leaf")


@dataclass
class _Leaf:
    x: np.ndarray
    iso: np.ndarray
    held: np.ndarray
    asked: np.ndarray
    ready: list[_Ready]

    def of(self, rows: slice | np.ndarray) -> _Leaf:
        return _Leaf(self.x[rows], self.iso[rows], self.held[rows], self.asked[rows], [r.of(rows) for r in self.ready])


def _by_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by (pa, pb) -> a table for each."""
    held, key = [], None
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pa", "pb"))
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end == start:
                continue
            if held and (a[start], b[start]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = a[start], b[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _meetings(table: pa.Table, text: bool, parts: list[slice], radii: list[float]) -> Iterator[tuple[_Leaf, _Leaf, bool]]:
    """Leaves of a task, and those that they meet, by about TILE rows; themselves alone, which the last value tells.

    Leaves that follow each other and want nearly the same others meet them together, as one: a pair of leaves that neither wants has no rows within the radii, so nothing more is found.
    """
    mark = pc.is_valid(table.column("wants"))
    marks, rows = table.filter(mark), table.filter(pc.invert(mark))
    x, iso = matrix(rows.column("v")), rows.column("iso_id")
    iso = np.array(iso.to_pylist(), object) if text else iso.to_numpy()
    with np.errstate(invalid="ignore", over="ignore"):
        ready = [_ready(x[:, p], radius) for p, radius in zip(parts, radii, strict=True)]
    every = _Leaf(x, iso, *(rows.column(c).to_numpy().astype(bool) for c in ("held", "asked")), ready)
    names = rows.column("leaf").combine_chunks().dictionary_encode()
    starts = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1))
    ends = np.append(starts[1:], len(x))[: len(starts)]
    at = {name: k for k, name in enumerate(names.dictionary.to_pylist())}
    wanted = {}
    for name, wants in zip(marks.column("leaf").to_pylist(), marks.column("wants").to_pylist(), strict=True):
        if name in at:
            wanted[at[name]] = np.array(sorted(at[w] for w in wants if w in at), np.int64)
    size = ends - starts
    for first, last, own, others in _together(wanted, size):
        if own:
            side = every.of(slice(starts[first], ends[last]))
            yield side, side, True
        turns = np.cumsum(size[others]) // TILE
        for cut in np.split(others, np.flatnonzero(np.diff(turns)) + 1):
            if len(cut):
                one = cut[-1] - cut[0] + 1 == len(cut)
                rest = slice(starts[cut[0]], ends[cut[-1]]) if one else np.concatenate([np.arange(starts[k], ends[k]) for k in cut])
                yield every.of(slice(starts[first], ends[last])), every.of(rest), False


def _together(wanted: dict[int, np.ndarray], size: np.ndarray) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """(first leaf, last leaf, whether they meet among themselves, the others that they meet): leaves that follow each other, BLOCK rows at most if more than one, as long as MORE of the pairs of rows are wanted. Leaves want none before themselves."""
    held: list[int] = []
    union, pairs = np.empty(0, np.int64), 0

    def ended() -> tuple[int, int, bool, np.ndarray]:
        among = (union >= held[0]) & (union <= held[-1])
        return held[0], held[-1], bool(among.any()), union[~among]

    for k in sorted(wanted):
        more, both = int(size[k] * size[wanted[k]].sum()), np.union1d(union, wanted[k])
        rows = int(size[[*held, k]].sum())
        if held and (k != held[-1] + 1 or rows > BLOCK or MORE * rows * size[both].sum() > pairs + more):
            yield ended()
            held, both, pairs = [], wanted[k], 0
        held.append(k)
        union, pairs = both, pairs + more
    if held:
        yield ended()


def directed(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways round."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(iso_id, degree), 0 for entities without neighbours. Edges are read once."""
    counts = edges.select(F.explode(F.array("a", "b")).alias("iso_id")).groupBy("iso_id").agg(F.count("*").alias("degree"))
    return points.select("iso_id").join(counts, "iso_id", "left").select("iso_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def average_neighbours(points: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(points, edges).agg(F.avg("degree").alias("avg_neighbours"))


def compare_neighbours(points: DataFrame, found: DataFrame, correct: DataFrame) -> DataFrame:
    """One row: queries, correct, non_empty, non_empty_correct, extra, missing, for two directed edge tables (src, dst).

    Edges are compared one by one and counted by query, so no query's neighbours are gathered.
    """
    f = found.select("src", "dst").distinct().withColumn("f", F.lit(1))
    c = correct.select("src", "dst").distinct().withColumn("c", F.lit(1))
    edges = f.join(c, ["src", "dst"], "full").groupBy("src").agg(F.count("f").alias("f"), F.count("c").alias("c"), F.count_if(F.col("f").isNotNull() & F.col("c").isNotNull()).alias("both"))
    return _compared(points, edges)


def compare_radii(points: DataFrame, found: list[float], correct: list[float], sizes: list[int], block: int = BLOCK) -> DataFrame:
    """compare_neighbours of the neighbours within two sets of radii, for points(iso_id, z), iso_id unique: one join finds both, and its tasks count them by entity, so no edge leaves a task."""
    iso = points.schema["iso_id"].dataType
    arrow = to_arrow_type(iso)
    text = not pa.types.is_integer(arrow)
    schema = pa.schema([("src", arrow), *[(c, pa.int64()) for c in ("f", "c", "both")]])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.empty(0, object if text else np.int64), np.zeros((0, 3), np.int64)
        for batch in batches:
            a, b = (np.array(batch.column(c).to_pylist(), object) if text else batch.column(c).to_numpy() for c in ("a", "b"))
            d = matrix(batch.column("distance"))
            near = [(d <= radii).all(1) for radii in (found, correct)]
            flags = np.stack([*near, near[0] & near[1]], 1).astype(np.int64)
            fresh, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            every = np.unique(np.concatenate([known, fresh]))
            total = np.zeros((len(every), 3), np.int64)
            total[np.searchsorted(every, known)] = counts
            total[np.searchsorted(every, fresh)] += np.stack([np.bincount(at, np.concatenate([f, f]), len(fresh)).astype(np.int64) for f in flags.T], 1)
            known, counts = every, total
        out = pa.table([pa.array(known, arrow), *[pa.array(c) for c in counts.T]], schema=schema)
        yield from out.to_batches(max_chunksize=1 << 16)

    wider = [max(r) for r in zip(found, correct, strict=True)]
    counted = similar_pairs(points, None, wider, sizes, block, True, False, (task, f"src {iso.simpleString()}, f long, c long, both long"))
    return _compared(points, counted.groupBy("src").agg(*[F.sum(c).alias(c) for c in ("f", "c", "both")]))


def _compared(points: DataFrame, edges: DataFrame) -> DataFrame:
    """compare_neighbours from (src, f, c, both), the numbers of an entity's neighbours."""
    per = points.select(F.col("iso_id").alias("src")).join(edges, "src", "left").na.fill(0, ["f", "c", "both"])
    same = (F.col("f") == F.col("both")) & (F.col("c") == F.col("both"))
    return per.agg(
        F.count("*").alias("queries"),
        F.count_if(same).alias("correct"),
        F.count_if(F.col("f") > 0).alias("non_empty"),
        F.count_if(same & (F.col("f") > 0)).alias("non_empty_correct"),
        F.coalesce(F.sum(F.col("f") - F.col("both")), F.lit(0)).cast("long").alias("extra"),
        F.coalesce(F.sum(F.col("c") - F.col("both")), F.lit(0)).cast("long").alias("missing"),
    )
