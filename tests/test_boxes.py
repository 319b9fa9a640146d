"""Range queries over boxes against brute force, and how many boxes never need a product."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.operators import boxes
from pairforge.plans.scratch import Scratch

REGIONS, WIDTHS = ["A", "B"], [8, 5]


def table(spark, x):
    return spark.createDataFrame([(i, [a.tolist(), b.tolist()]) for i, (a, b) in enumerate(zip(*x, strict=True))], "iso_id long, z array<array<double>>")


def brute(x, radii, ask):
    near = [np.linalg.norm(m[:, None] - m[None], axis=2) <= r for m, r in zip(x, radii, strict=True)]
    return {(i, j) for i, j in zip(*np.nonzero(near[0] & near[1]), strict=True) if i != j and ask(i)}


def made(n, spread, seed=1):
    rng = np.random.default_rng(seed)
    centers = [rng.normal(size=(12, w)) * 6 for w in WIDTHS]
    which = rng.integers(0, 12, n)
    return [c[which] + rng.normal(scale=spread, size=(n, w)) for c, w in zip(centers, WIDTHS, strict=True)]


@pytest.mark.parametrize("radii", [[0.3, 0.3], [2.0, 1.5], [40.0, 40.0]])
def test_range_query_equals_brute_force(spark, radii):
    x = made(600, 0.1)
    x = [np.concatenate([m, np.repeat(m[:1], 90, axis=0)]) for m in x]  # copies beyond a block
    df = table(spark, x)
    got = boxes.within_range(df, df.where("iso_id % 7 = 0"), REGIONS, WIDTHS, radii, block=32)
    assert {(r.query_id, r.iso_id) for r in got.collect()} == brute(x, radii, lambda i: i % 7 == 0) and got.count() == got.distinct().count()


def test_queries_that_are_no_points_and_empty_sides(spark):
    x = made(200, 0.5)
    df = table(spark, x)
    asked = df.where("iso_id < 5").withColumn("iso_id", F.col("iso_id") + 1000)
    got = {(r.query_id, r.iso_id) for r in boxes.within_range(df, asked, REGIONS, WIDTHS, [1.0, 1.0], block=32).collect()}
    assert {(q - 1000, i) for q, i in got} == {(i, j) for i, j in brute(x, [1.0, 1.0], lambda i: i < 5)} | {(i, i) for i in range(5)}
    none = df.where("false")
    for points, queries in ((df, none), (none, asked), (none, none)):
        assert boxes.within_range(points, queries, REGIONS, WIDTHS, [1.0, 1.0]).count() == 0


def test_boxes_are_pruned_and_taken_whole(spark):
    x = made(3000, 0.02)
    df, radii = table(spark, x), [1.0, 1.0]
    scratch = Scratch(spark)
    tree = boxes.build(df, df.where("iso_id % 10 = 0"), REGIONS, WIDTHS, scratch, 64)
    sizes = {r.box: r["count"] for r in tree.rows.groupBy("box").count().collect()}
    assert sum(sizes.values()) == 3000 and len(sizes) > 30 and max(sizes.values()) <= 100
    for r in tree.nodes.where("parent = box").join(tree.rows, "box").groupBy("box").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.collect_list("v").alias("v")).collect():
        assert np.allclose(np.min(r.v, 0), r.low) and np.allclose(np.max(r.v, 0), r.high)
    whole, single = boxes.met_boxes(tree, WIDTHS, radii, scratch)
    every = 300 * len(sizes)
    left = single.where("not inside").count()
    assert left < 0.02 * every  # nearly all pairs of a query and a box are left out or taken without a product
    assert whole.count() + single.where("inside").count() > 0
    got = boxes.within_range(df, df.where("iso_id % 10 = 0"), REGIONS, WIDTHS, radii, block=64)
    assert {(r.query_id, r.iso_id) for r in got.collect()} == brute(x, radii, lambda i: i % 10 == 0)


def test_a_row_is_sent_to_as_many_tasks_as_there_are_bundles(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(2600, w)) for w in WIDTHS]  # no structure: every query meets nearly every box
    df, radii, sent = table(spark, x), [2.5, 2.0], []
    scratch = Scratch(spark)
    tree = boxes.build(df, df.where("iso_id % 4 = 0"), REGIONS, WIDTHS, scratch, 16)
    _, left = boxes.met_blocks(tree, WIDTHS, radii, scratch)
    every = lambda m: pa.table({"points": [len(m.points)], "queries": [len(m.queries)]})
    for r in boxes._met_in_tasks(tree, left, WIDTHS, radii, every, "points long, queries long", scratch).collect():
        sent.append((r.points, r.queries))
    assert tree.blocks.count() <= 3 and tree.rows.select("box").distinct().count() > 200
    assert sum(p for p, _ in sent) <= 3 * 2600 and len(sent) < 30
    got = boxes.within_range(df, df.where("iso_id % 4 = 0"), REGIONS, WIDTHS, radii, block=16)
    assert {(r.query_id, r.iso_id) for r in got.collect()} == brute(x, radii, lambda i: i % 4 == 0)
