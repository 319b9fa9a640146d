"""Region and parameter configuration from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.vectors import distance_from_pearson

SCHEMA = (
    "regions array<struct<name: string, dispCount: int, clusterThreshold: double, pearsonSimilarityThresholdAlpha: double,"
    " pearsonSimilarityThresholdBeta: double, betaDistributionAlpha: double, betaDistributionBeta: double>>,"
    " minNeighbors int, pointsPerLeaf int, dimsPerSplit int, isolateSubsetSize string"
)


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(regions, parameters). regions(region, disp_count, cluster_threshold, alpha, beta, beta_a, beta_b, radius); a missing key raises."""
    raw = spark.read.option("multiLine", True).schema(SCHEMA).json(path)
    r = raw.select(F.explode("regions").alias("r")).select(
        F.col("r.name").alias("region"),
        F.col("r.dispCount").alias("disp_count"),
        F.col("r.clusterThreshold").alias("cluster_threshold"),
        F.col("r.pearsonSimilarityThresholdAlpha").alias("alpha"),
        F.col("r.pearsonSimilarityThresholdBeta").alias("beta"),
        F.col("r.betaDistributionAlpha").alias("beta_a"),
        F.col("r.betaDistributionBeta").alias("beta_b"),
    )
    if not r.where(" or ".join(f"{c} is null" for c in r.columns)).isEmpty():
        raise ValueError(f"a region in {path} lacks a value")
    first = raw.select("minNeighbors", "pointsPerLeaf", "dimsPerSplit", "isolateSubsetSize").first()
    return r.withColumn("radius", distance_from_pearson(F.col("cluster_threshold"), F.col("disp_count"))), first.asDict()
