"""Statistics of the dimensions of a region's vectors: spread, correlation, choice of split dimensions, boxes, medians."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import projection
from pairforge.operators.pivots import matrix
from pairforge.plans.ranks import running_sums
from pairforge.plans.scratch import Scratch


def exploded(profiles: DataFrame, *keys: str) -> DataFrame:
    """(keys, iso_id, region, dim, v), dim from 0."""
    return profiles.select(*keys, "iso_id", "region", F.posexplode("z").alias("dim", "v"))


def dim_profile(profiles: DataFrame) -> DataFrame:
    """(region, dim, n, mean, std): population statistics of each dimension."""
    return exploded(profiles).groupBy("region", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def main_dims(stats: DataFrame) -> DataFrame:
    """(region, main): the dimension with the largest spread; ties go to the smaller one."""
    return stats.groupBy("region").agg(F.max_by("dim", F.struct("std", -F.col("dim"))).alias("main"))


def dim_correlation(profiles: DataFrame, mains: DataFrame) -> DataFrame:
    """(region, dim, correlation) with the main dimension: sample covariance over population deviations. Null without spread."""
    at_main = profiles.join(F.broadcast(mains), "region").select("iso_id", "region", F.element_at("z", F.col("main") + 1).alias("m"), "z")
    rows = at_main.select("region", "m", F.posexplode("z").alias("dim", "v"))
    spread = F.stddev_pop("v") * F.stddev_pop("m")
    return rows.groupBy("region", "dim").agg(F.try_divide(F.covar_samp("v", "m"), spread).alias("correlation"))


def moments(profiles: DataFrame) -> DataFrame:
    """(region, i, j, n, c), i <= j: co-moments about the means of all pairs of dimensions, in one pass over the profiles.

    A task makes one matrix a region about its own means; these, one row a task and region, are then moved to the means of all and added up. Profiles of another
    length than their region's longest are left out.
    """
    scratch = Scratch(profiles.sparkSession)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for batch in batches:
            region, size = np.array(batch.column(0).to_pylist(), object), np.diff(batch.column(1).offsets.to_numpy())
            for key in set(zip(region.tolist(), size.tolist(), strict=True)):
                x = matrix(batch.column(1).filter(pa.array((region == key[0]) & (size == key[1]))))
                n, mean = len(x), x.mean(0)
                c = (x - mean).T @ (x - mean)
                if key in found:
                    m, before, d = found[key]
                    shift = mean - before
                    n, mean, c = m + n, before + shift * n / (m + n), d + c + np.outer(shift, shift) * (m * n / (m + n))
                found[key] = [n, mean, c]
        for (r, _), (n, mean, c) in found.items():
            yield pa.record_batch([pa.array([r]), pa.array([n]), pa.array([mean]), pa.array([c.ravel()])], names=["region", "n", "mean", "c"])

    rows = profiles.where("z is not null").select("region", F.transform("z", lambda x: x.cast("double")).alias("z"))
    parts = scratch.keep(rows.mapInArrow(own, "region string, n long, mean array<double>, c array<double>"))
    parts = parts.join(F.broadcast(parts.groupBy("region").agg(F.max(F.size("mean")).alias("d"))), "region").where(F.size("mean") == F.col("d")).drop("d")
    weighed = parts.select("region", "n", F.posexplode("mean").alias("i", "m")).groupBy("region", "i").agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m"))
    means: dict[str, tuple[int, dict[int, float]]] = {}
    for r in weighed.collect():  # a row a dimension
        means.setdefault(r.region, (r.n, {}))[1][r.i] = r.m

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                shift = np.array(r["mean"]) - np.array([means[r["region"]][1][i] for i in range(len(r["mean"]))])
                sums[r["region"]] = sums.get(r["region"], 0.0) + np.array(r["c"]).reshape(len(shift), -1) + np.outer(shift, shift) * r["n"]
        for region, c in sums.items():
            i, j = np.triu_indices(len(c))
            yield pa.record_batch([pa.array([region] * len(i)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(c[i, j])], names=["region", "i", "j", "c"])

    total = parts.mapInArrow(moved, "region string, i int, j int, c double").groupBy("region", "i", "j").agg(F.sum("c").alias("c"))
    counts = profiles.sparkSession.createDataFrame([(r, n) for r, (n, _) in means.items()], "region string, n long")
    return total.join(F.broadcast(counts), "region").select("region", "i", "j", "n", "c")  # a row a region


def split_planes(profiles: DataFrame, dims_per_split: int) -> DataFrame:
    """(region, round, rank, dim, coefficient): in every round the unused dimensions with the highest std * |correlation| with the
    main one, until none is left. All rounds read one table of co-moments, a row a pair of dimensions.
    """
    by_region: dict[str, list] = {}
    for r in moments(profiles).collect():  # the square of the dimensions
        by_region.setdefault(r.region, []).append(r)
    out = []
    for region, found in sorted(by_region.items()):
        d, n = max(r.j for r in found) + 1, found[0].n
        c = np.zeros((d, d))
        for r in found:
            c[r.i, r.j] = c[r.j, r.i] = max(r.c, 0.0) if r.i == r.j else r.c
        std = np.sqrt(np.diag(c) / n)
        left, turn = list(range(d)), 0
        while left:
            main = max(left, key=lambda k: (std[k], -k))
            spread = std * std[main]
            # Sample covariance over population deviations; none without spread, or of one row.
            correlation = {k: float(c[main, k] / (n - 1) / spread[k]) if n > 1 and spread[k] > 0 else None for k in left}
            ranked = sorted(left, key=lambda k: (correlation[k] is None, -std[k] * abs(correlation[k] or 0.0), k))[:dims_per_split]
            for rank, k in enumerate(ranked, 1):
                coefficient = 1.0 if rank == 1 else float(correlation[k] * std[ranked[0]] / std[k]) if correlation[k] is not None else None
                out.append((region, turn, rank, k, coefficient))
            left = [k for k in left if k not in ranked]
            turn += 1
    return profiles.sparkSession.createDataFrame(out, "region string, round int, rank int, dim int, coefficient double")


def bounding_boxes(profiles: DataFrame, group: str) -> DataFrame:
    """(group, region, low, high): arrays of the least and largest element of each dimension."""
    per = exploded(profiles, group).groupBy(group, "region", "dim").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ordered = per.groupBy(group, "region").agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("d"))
    return ordered.select(group, "region", F.transform("d", lambda x: x["low"]).alias("low"), F.transform("d", lambda x: x["high"]).alias("high"))


def merged_boxes(boxes: DataFrame, by: str) -> DataFrame:
    """(by, region, low, high): the boxes around boxes."""
    rows = boxes.select(by, "region", F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")).groupBy(by, "region", "dim").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    ordered = rows.groupBy(by, "region").agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("d"))
    return ordered.select(by, "region", F.transform("d", lambda x: x["low"]).alias("low"), F.transform("d", lambda x: x["high"]).alias("high"))


def median_split(profiles: DataFrame, dims: list[int], coefficients: list[float], by: list[str]) -> DataFrame:
    """(by, split): mean of the projections at 0-based ranks n // 2 and n // 2 + 1; the last one twice where there are too few. No group is sorted as a whole."""
    values = profiles.select(*by, projection(F.col("z"), dims, coefficients).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("k"))
    run = running_sums(values, by, ["v"], {"r": "k"}, Scratch(profiles.sparkSession))
    half = F.floor(F.col("r_all") / 2)
    at = lambda rank: F.max(F.when((F.col("r") - F.col("k") <= rank) & (rank < F.col("r")), F.col("v")))
    low, high = F.least(half, F.col("r_all") - 1), F.least(half + 1, F.col("r_all") - 1)
    return run.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("split"))
