"""Whether a clustering fits the neighbour graph by definition; reachability; equality of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.components import connected_components
from pairforge.operators.dbscan import SHARED, among_cores, cores_of, once
from pairforge.plans.joins import salted_join
from pairforge.plans.scratch import Scratch


def _homes(rows: DataFrame, cores: DataFrame, name: str) -> DataFrame:
    """(name, clusters_name: an entity's clusters in rows(cluster_id, iso_id), cores_name: those that it is a core of, by cores(cluster_id, iso_id)); sent to where pairs lie while they are few."""
    each = rows.join(cores.withColumn("c", F.lit(True)), ["cluster_id", "iso_id"], "left").where("cluster_id is not null and iso_id is not null")
    homes = each.groupBy(F.col("iso_id").alias(name)).agg(F.collect_set("cluster_id").alias(f"clusters_{name}"), F.collect_set(F.when(F.col("c"), F.col("cluster_id"))).alias(f"cores_{name}"))
    return F.broadcast(homes) if rows.count() <= SHARED else homes


def audit(edges: DataFrame, membership: DataFrame, min_neighbors: int, distinct: bool = False) -> DataFrame:
    """(check, violations): existence, maximality, membership and connectivity of density clusters.

    existence: cores that are not in exactly one cluster. maximality: edges from a core to an entity outside the core's cluster.
    membership: members that are neither a core nor the neighbour of a core of that cluster. connectivity: clusters
    whose cores make more than one component. distinct: no edge is there twice, either way round.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.select("a", "b") if distinct else scratch.keep(once(edges))
    cores = scratch.keep(cores_of(edges, min_neighbors).withColumnRenamed("core", "iso_id"))
    rows = scratch.keep(membership.select("cluster_id", "iso_id").distinct())
    of_core = scratch.keep(rows.join(cores, "iso_id", "left_semi").select("cluster_id", "iso_id"))
    homes = cores.join(of_core, "iso_id", "left").groupBy("iso_id").agg(F.count("cluster_id").alias("n"))
    existence = homes.where("n != 1").agg(F.count("*").alias("violations")).select(F.lit("existence").alias("check"), "violations")
    met = edges.where("a != b").join(_homes(rows, of_core, "a"), "a", "left").join(_homes(rows, of_core, "b"), "b", "left")
    none = lambda c: F.coalesce(c, F.array())
    beyond = lambda x, y: F.size(F.array_except(none(f"cores_{x}"), none(f"clusters_{y}")))
    maximality = met.agg(F.coalesce(F.sum(beyond("a", "b") + beyond("b", "a")), F.lit(0)).alias("violations")).select(F.lit("maximality").alias("check"), "violations")
    ends = F.array(*[F.struct(none(f"cores_{x}").alias("clusters"), F.col(y).alias("iso_id")) for x, y in ("ab", "ba")])
    reach = met.select(F.explode(ends).alias("x")).select(F.explode("x.clusters").alias("cluster_id"), "x.iso_id").groupBy("cluster_id", "iso_id").agg(F.lit(1).alias("_")).drop("_")
    stray = rows.join(cores, "iso_id", "left_anti").join(reach, ["cluster_id", "iso_id"], "left_anti")
    belongs = stray.agg(F.count("*").alias("violations")).select(F.lit("membership").alias("check"), "violations")
    parts = connected_components(among_cores(edges, cores.withColumnRenamed("iso_id", "core"))).withColumnRenamed("node", "iso_id")
    apart = of_core.join(parts, "iso_id", "left").select("cluster_id", F.coalesce("component", "iso_id").alias("component")).distinct().groupBy("cluster_id").count().where("count > 1")
    connectivity = apart.agg(F.count("*").alias("violations")).select(F.lit("connectivity").alias("check"), "violations")
    return existence.unionByName(maximality).unionByName(belongs).unionByName(connectivity)


def density_relations(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """pairs(p, q) with reachable (p is a core of a cluster that has q) and connected (both share a cluster) added. Clusters go to the pairs, which stay where they lie."""
    members = Scratch(pairs.sparkSession).keep(membership.select("cluster_id", "iso_id", "is_core").distinct())
    rows, cores = members.select("cluster_id", "iso_id").distinct(), members.where("is_core").select("cluster_id", "iso_id")
    found = pairs.join(_homes(rows, cores, "p"), "p", "left").join(_homes(rows, cores, "q"), "q", "left")
    meet = lambda c: F.coalesce(F.arrays_overlap(c, "clusters_q"), F.lit(False))
    return found.select("p", "q", meet("cores_p").alias("reachable"), meet("clusters_p").alias("connected"))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(side, cluster_id, iso_id): the members of clusters that only one of two clusterings has, as a set. No rows: they are equal.

    Clusters are compared by their size and two order-free 64-bit digests of their members; no cluster is gathered.
    """

    def digests(m: DataFrame) -> DataFrame:
        two = [F.bit_xor(F.xxhash64(F.lit(k), F.col("iso_id"))).alias(f"d{k}") for k in (1, 2)]
        return m.select("cluster_id", "iso_id").distinct().groupBy("cluster_id").agg(F.count("*").alias("size"), *two)

    a, b, key = digests(first), digests(second), ["size", "d1", "d2"]

    def only(side: str, own: DataFrame, other: DataFrame, members: DataFrame) -> DataFrame:
        apart = own.join(other.select(key), key, "left_anti").select("cluster_id")
        return salted_join(members.select("cluster_id", "iso_id").distinct(), apart, ["cluster_id"]).select(F.lit(side).alias("side"), "cluster_id", "iso_id")

    return only("first", a, b, first).unionByName(only("second", b, a, second))
