"""The whole jobs, on planted clusters read from a database."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions.vectors import signed_plane_distance
from pairforge.operators import ks
from pairforge.plans import jobs
from pairforge.sources.stages import load_or_compute, read_jdbc

WIDTH = {"r1": 12, "r2": 8}


def z(x):
    return (x - x.mean()) / x.std()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three groups of eight isolates with two to three prints each, a lone isolate, one with a region missing and one with an erroneous print."""
    rng = np.random.default_rng(1)
    prints, values, n = [], [], 0
    for group in range(3):
        base = {r: rng.normal(size=w) for r, w in WIDTH.items()}
        for k in range(8):
            for _ in range(2 + k % 2):
                for r, w in WIDTH.items():
                    prints.append((n, f"g{group}i{k}", r, False))
                    values += [(n, i, float(x)) for i, x in enumerate(z(base[r] + rng.normal(size=w) * 0.02))]
                    n += 1
    for iso, regions, bad in (("lone", ["r1", "r2"], False), ("half", ["r1"], False), ("wrong", ["r1", "r2"], True)):
        for r in regions:
            prints.append((n, iso, r, bad))
            values += [(n, i, float(x)) for i, x in enumerate(z(rng.normal(size=WIDTH[r])))]
            n += 1
    url = f"jdbc:derby:memory:{tmp_path_factory.mktemp('db').name};create=true"
    options = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame(prints, "print_id long, iso_id string, region string, is_erroneous boolean").write.format("jdbc").options(**options, dbtable="prints", createTableColumnTypes="iso_id varchar(20), region varchar(20)").save()
    spark.createDataFrame(values, "print_id long, position int, z double").write.format("jdbc").options(**options, dbtable="zs").save()
    read = lambda name: read_jdbc(spark, url, name, "print_id", 0, n, 3, driver=options["driver"])
    return read("prints"), read("zs")


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("job")
    one = {"clusterThreshold": 0.9, "pearsonSimilarityThresholdAlpha": 0.9, "pearsonSimilarityThresholdBeta": 0.8, "betaDistributionAlpha": 8.0, "betaDistributionBeta": 8.0}
    config = {"regions": [{"name": r, "dispCount": w, **one} for r, w in WIDTH.items()], "minNeighbors": 2, "pointsPerLeaf": 8, "dimsPerSplit": 4, "isolateSubsetSize": "All"}
    (at / "c.json").write_text(json.dumps(config))
    return jobs.job(spark, str(at / "c.json"), str(at / "stages"))


def test_cluster_job_reads_a_database_and_stores_its_stages(spark, tables, job, monkeypatch):
    prints, z_long = tables
    assert prints.rdd.getNumPartitions() == 3 and prints.where("is_erroneous").count() == 2
    assert {r.iso_id for r in jobs.points(job, prints, z_long).collect()} == {f"g{g}i{k}" for g in range(3) for k in range(8)} | {"lone"}
    got = jobs.clusters(job, prints, z_long).groupBy("cluster_id").agg(F.array_sort(F.collect_list("iso_id")).alias("m")).collect()
    assert sorted(r.m for r in got) == [[f"g{g}i{k}" for k in range(8)] for g in range(3)]
    assert jobs.clusters(job, spark.createDataFrame([], prints.schema), z_long.where("false")).count() == 0  # other inputs are other stages

    def fails(*_):
        raise AssertionError("made again")

    monkeypatch.setattr(jobs.dbscan, "dbscan", fails)
    assert jobs.clusters(job, prints, z_long).count() == 24  # read, not made again


def test_quality_job(tables, job):
    prints, z_long = tables
    own = jobs.clusters(job, prints, z_long)
    mixed = own.withColumn("cluster_id", F.substring("iso_id", -1, 1))  # a member of each group
    got = {(r.clustering, r.test, r.region, r.measure): r for r in jobs.quality(job, prints, z_long, {"own": own, "mixed": mixed}).collect()}
    assert got["own", "cluster", "r1", "d"].n == 3 and got["own", "pair", "r2", "d"].n == 3
    assert not any(k[0] == "mixed" for k in got)  # three members are too few, and six together
    sample = jobs.expected(job, prints, z_long)
    assert {r.region: r.n_expected for r in sample.totals.collect()} == {r: 12 * 1 + 12 * 3 for r in WIDTH}
    biggest = ks.cluster_ks(own.select(F.lit(1).alias("cluster_id"), "iso_id"), jobs.points(job, prints, z_long), job.names, sample)
    assert {r.region: r.n for r in biggest.collect()} == {r: 24 * 23 // 2 for r in WIDTH}


def test_comparison_job(spark, tables, job):
    lines = ["title", "Cluster Id,Isolate"] + [f"{g},g{g}i{k}" for g in range(2) for k in range(8)] + ["2,g2i0", "3,unknown"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    listed = spark.createDataFrame([(f"g{g}i{k}",) for g in range(3) for k in range(8)] + [("other",)], "iso_id string")
    got = {(r.clustering, r.measure): r.value for r in jobs.comparison(job, *tables, listed, lines).collect()}
    assert (got["own", "n_clusters"], got["own", "noise"], got["own", "correct_ds"], got["own", "correct_dd"]) == (3, 0, 1, 1)
    assert (got["f", "n_clusters"], got["f", "noise"], got["f", "from_8"]) == (2, 8, 2)
    assert (got["f", "both_same"], got["f", "one_of_each"], got["f", "both_diff"]) == (56, 28, 192)
    assert got["f", "correct_ds"] == pytest.approx(2 / 3) and got["f", "jaccard"] == pytest.approx(56 / 84)


def test_a_failed_stage_is_made_again(spark, tmp_path):
    (tmp_path / "s" / "_temporary").mkdir(parents=True)
    assert load_or_compute(spark, str(tmp_path / "s"), lambda: spark.range(4)).count() == 4


def test_signed_plane_distance(spark):
    at = lambda x: signed_plane_distance(F.lit(x), 10.0, [3.0, 4.0])
    assert tuple(spark.range(1).select(at(20.0), at(5.0)).first()) == (2.0, -1.0)
