"""Whole batch jobs over a configuration and tables: cluster the entities, judge clusterings, compare with clusterings made elsewhere.

Every costly stage is stored under a path that names its parameters and a fingerprint of its input tables, and is read from there the next time. Inputs are
prints(print_id, iso_id, region, is_erroneous) and z_long(print_id, position, z), from read_jdbc or read_table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import compare, correctness, dbscan, ks, neighbors, profiles
from pairforge.plans.scratch import Scratch
from pairforge.sources import lists
from pairforge.sources.config import read_config
from pairforge.sources.stages import fingerprint, load_or_compute, stage_path


@dataclass
class Job:
    spark: SparkSession
    folder: str
    regions: DataFrame  # region, disp_count, ...: a row a region
    names: list[str]
    sizes: list[int]
    radii: list[float]
    alphas: list[float]
    betas: list[float]
    min_neighbors: int
    subset: str
    seen: dict = field(default_factory=dict)

    def inputs(self, *tables: DataFrame) -> str:
        """The fingerprint of the tables, taken once a job."""
        key = tuple(map(id, tables))
        if key not in self.seen:
            self.seen[key] = (fingerprint(*tables), tables)  # tables are held, so that no other takes their ids
        return self.seen[key][0]

    def stage(self, name: str, make, **parameters: object) -> DataFrame:
        return load_or_compute(self.spark, stage_path(self.folder, name, **parameters), make)


def job(spark: SparkSession, config: str, folder: str) -> Job:
    """config: the path of the JSON; folder: where stages are stored, shared by all executors."""
    regions, parameters = read_config(spark, config)
    rows = regions.orderBy("region").collect()  # a row a region of the configuration
    of = lambda c: [r[c] for r in rows]
    return Job(spark, folder, regions, of("region"), of("disp_count"), of("radius"), of("alpha"), of("beta"), parameters["minNeighbors"], parameters["isolateSubsetSize"])


def points(j: Job, prints: DataFrame, z_long: DataFrame) -> DataFrame:
    """(iso_id, z): entities with a whole profile in every region, all or the configured number of them."""

    def make() -> DataFrame:
        good, _ = profiles.checked(profiles.vectors(prints, z_long), j.regions)
        return profiles.exact_sample(profiles.wide(good, j.names), j.subset)

    return j.stage("points", make, size=j.subset, inputs=j.inputs(prints, z_long))


def clusters(j: Job, prints: DataFrame, z_long: DataFrame) -> DataFrame:
    """(cluster_id, iso_id, is_core): density clusters of the entities at the configured thresholds."""
    at = {"size": j.subset, "inputs": j.inputs(prints, z_long), "radii": "_".join(f"{r:.6f}" for r in j.radii)}
    edges = j.stage("edges", lambda: neighbors.similar_pairs(points(j, prints, z_long), None, j.radii, j.sizes).select("a", "b"), **at)
    return j.stage("clusters", lambda: dbscan.dbscan(edges, j.min_neighbors), min_neighbors=j.min_neighbors, **at)


def expected(j: Job, prints: DataFrame, z_long: DataFrame) -> ks.Expected:
    """Similarities of the newest valid prints of one entity."""

    def make() -> DataFrame:
        newest = profiles.newest_valid(prints, 10).select("print_id", "region").join(z_long, "print_id")
        vectors = newest.groupBy("print_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "z"))), lambda p: p["z"]).alias("z"))
        return profiles.replicate_pairs(prints, vectors, j.regions)

    return ks.expected_sample(j.stage("replicates", make, inputs=j.inputs(prints, z_long)))


def quality(j: Job, prints: DataFrame, z_long: DataFrame, clusterings: dict[str, DataFrame], function: ks.Correctness = ks.slot_ks) -> DataFrame:
    """(clustering, test, region, measure, n, min, max, mean, variance, skewness, kurtosis) of the tests of all clusters and of all pairs of clusters.

    function: the correctness function, which gives d, weighted and p a group.
    """
    all_points, sample, scratch = points(j, prints, z_long), expected(j, prints, z_long), Scratch(j.spark)
    out = []
    for name, membership in clusterings.items():
        for test, run in (("cluster", ks.cluster_ks), ("pair", ks.paired_ks)):
            rows = scratch.keep(run(membership, all_points, j.names, sample, function))
            out.append(ks.describe(rows, ["d", "weighted", "p"], ["region"]).select(F.lit(name).alias("clustering"), F.lit(test).alias("test"), "*"))
    return reduce(DataFrame.unionByName, out)


def imported(j: Job, all_points: DataFrame, listed: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, cluster_id, iso_id) of the entities that the list(iso_id) and the points share, without clusters of one. lines(file, line_no, line)."""
    shared = lists.list_difference(all_points, listed).where("status = 'shared'").select("iso_id")
    rows = lists.import_clusters(lines, shared).withColumnRenamed("cluster_ord", "cluster_id")
    large = rows.groupBy("file", "cluster_id").agg(F.count_distinct("iso_id").alias("n")).where("n > 1").select("file", "cluster_id")
    return Scratch(j.spark).keep(rows.join(large, ["file", "cluster_id"], "left_semi"))


def _measures(one_row: DataFrame, clustering: str) -> DataFrame:
    values = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.lit(clustering).alias("clustering"), F.explode(values).alias("m")).select("clustering", "m.*")


def comparison(j: Job, prints: DataFrame, z_long: DataFrame, listed: DataFrame, lines: DataFrame) -> DataFrame:
    """(clustering, measure, value): statistics, size bins, pair agreement with the density clusters (called own) and threshold
    correctness of every imported file, over the entities that the list and the points share."""
    all_points = points(j, prints, z_long)
    foreign = imported(j, all_points, listed, lines)
    shared = Scratch(j.spark).keep(all_points.join(listed.select("iso_id").distinct(), "iso_id", "left_semi"))
    own = compare.without_singletons(clusters(j, prints, z_long).join(shared.select("iso_id"), "iso_id", "left_semi")).select("cluster_id", "iso_id")
    least = [(2 * n * (1 - b)) ** 0.5 for n, b in zip(j.sizes, j.betas, strict=True)]
    above = " and ".join(f"pearson[{k}] > {b!r}" for k, b in enumerate(j.betas))
    near = Scratch(j.spark).keep(neighbors.similar_pairs(shared, None, least, j.sizes).where(above))
    names = [r.file for r in foreign.select("file").distinct().orderBy("file").collect()]  # a row a file
    all_ = [("own", own)] + [(n, foreign.where(F.col("file") == n).select("cluster_id", "iso_id")) for n in names]
    out = []
    for name, membership in all_:
        tables = [compare.cluster_stats(shared, membership), compare.size_histogram(membership), correctness.threshold_correctness(shared, membership, near, j.alphas, j.betas)]
        if name != "own":
            counts = Scratch(j.spark).keep(compare.pair_counts(shared, own, membership))
            tables += [counts, compare.similarity_indexes(counts).withColumnRenamed("average", "index_average")]
        out += [_measures(t, name) for t in tables]
    return reduce(DataFrame.unionByName, out)
