"""Pairs by similarity thresholds, and how well a clustering keeps similar pairs together and dissimilar ones apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.compare import cluster_map


def pair_class(pearson: Column, alphas: list[float], betas: list[float]) -> Column:
    """DS if all regions are alpha or more, else DD if any is beta or less, else squishy."""
    every = reduce(lambda x, y: x & y, [pearson[k] >= a for k, a in enumerate(alphas)])
    some = reduce(lambda x, y: x | y, [pearson[k] <= b for k, b in enumerate(betas)])
    return F.when(every, "DS").when(some, "DD").otherwise("squishy")


def pair_class_counts(points: DataFrame, near: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """(kind, n) of all pairs of points: DS, DD and squishy. near(a, b, pearson) holds all pairs above beta in every region; DD are all others, counted from the total and never made."""
    if any(a <= b for a, b in zip(alphas, betas, strict=True)):
        raise ValueError("every alpha has to exceed its beta")
    kind = pair_class(F.col("pearson"), alphas, betas)
    found = near.agg(F.count_if(kind == "DS").alias("ds"), F.count_if(kind == "squishy").alias("squishy")).withColumn("_k", F.lit(1))
    total = points.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("total")).withColumn("_k", F.lit(1))
    rows = found.join(F.broadcast(total), "_k")  # one row each
    kinds = [("DS", F.col("ds")), ("squishy", F.col("squishy")), ("DD", F.col("total") - F.col("ds") - F.col("squishy"))]
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("long").alias("n")) for k, n in kinds])).alias("x")).select("x.*")


def threshold_correctness(points: DataFrame, membership: DataFrame, near: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """One row: correct_ds, correct_dd, mean, tc_score, squishy_ratio; null where a denominator is 0.

    near(a, b, pearson) holds all pairs above beta in every region. With alpha > beta every other pair is DD, so DD pairs
    are counted from the totals and never made. membership(cluster_id, iso_id); an entity's last cluster counts.
    """
    if any(a <= b for a, b in zip(alphas, betas, strict=True)):
        raise ValueError("every alpha has to exceed its beta")
    one = F.lit(1).alias("_k")
    home = cluster_map(membership).select("iso_id", "cluster_id")
    rows = near.select("a", "b", pair_class(F.col("pearson"), alphas, betas).alias("kind")).where("kind != 'DD'")
    sides = [home.select(F.col("iso_id").alias(x), F.col("cluster_id").alias(f"c{x}")) for x in "ab"]
    rows = rows.join(sides[0], "a", "left").join(sides[1], "b", "left").withColumn("same", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
    counts = rows.agg(
        F.count_if(F.col("kind") == "DS").alias("ds"),
        F.count_if((F.col("kind") == "DS") & F.col("same")).alias("same_ds"),
        F.count_if(F.col("kind") == "squishy").alias("squishy"),
        F.count_if(F.col("same")).alias("same_near"),
    ).select("*", one)
    inside = home.join(points.select("iso_id"), "iso_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n"))
    same = inside.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("same")).select("*", one)
    total = points.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("total")).select("*", one)
    t = counts.join(same, "_k").join(total, "_k").withColumn("dd", F.col("total") - F.col("ds") - F.col("squishy"))
    t = t.withColumn("diff_dd", F.col("dd") - (F.col("same") - F.col("same_near")))
    t = t.select(
        F.try_divide("same_ds", "ds").alias("correct_ds"),
        F.try_divide("diff_dd", "dd").alias("correct_dd"),
        F.try_divide(F.col("same_ds") + F.col("diff_dd"), F.col("ds") + F.col("dd")).alias("tc_score"),
        F.try_divide("squishy", "total").alias("squishy_ratio"),
    )
    return t.select("correct_ds", "correct_dd", ((F.col("correct_ds") + F.col("correct_dd")) / 2).alias("mean"), "tc_score", "squishy_ratio")
