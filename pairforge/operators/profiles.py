"""From relational tables of repeated measurements to one vector for each entity and block ("region")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.functions.vectors import pearson, zscore


#: Hexadecimal digits that a step of a selection counts, and the rows that are put in order at its end.
RADIX, SELECTED = 4, 100_000


def valid_prints(prints: DataFrame) -> DataFrame:
    """prints whose is_erroneous is false; null is not valid."""
    return prints.where("is_erroneous IS FALSE")


def newest_valid(prints: DataFrame, at_most: int = 1) -> DataFrame:
    """The newest valid prints of each (iso_id, region) by print_id, with their rank. One shuffle; Spark limits groups before it."""
    newest = W.partitionBy("iso_id", "region").orderBy(F.desc("print_id"))
    return valid_prints(prints).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= at_most)


def replicate_groups(prints: DataFrame) -> DataFrame:
    """(iso_id, region, n): groups with more than one valid print."""
    return valid_prints(prints).groupBy("iso_id", "region").agg(F.count("*").alias("n")).where("n > 1")


def complete(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows(iso_id, region, ...) of entities that have every region; unknown regions are left out first."""
    known = rows.join(F.broadcast(regions.select("region").distinct()), "region", "left_semi")
    n = regions.select("region").distinct().count()
    whole = known.groupBy("iso_id").agg(F.count_distinct("region").alias("n")).where(F.col("n") == n).select("iso_id")
    return known.join(whole, "iso_id", "left_semi")


def vectors(prints: DataFrame, z_long: DataFrame) -> DataFrame:
    """(iso_id, region, z, dense): elements of the newest valid print in the order of position.

    The print is chosen before its elements are joined: a newest print without elements leaves the entity without the region.
    dense tells whether positions run from 0 without gaps or repeats.
    """
    rows = newest_valid(prints).select("print_id", "iso_id", "region").join(z_long, "print_id")
    made = rows.groupBy("iso_id", "region").agg(F.array_sort(F.collect_list(F.struct("position", "z"))).alias("parts"))
    dense = F.forall("parts", lambda p: F.element_at("parts", p["position"] + 1)["position"] == p["position"])
    in_range = F.forall("parts", lambda p: (p["position"] >= 0) & (p["position"] < F.size("parts")))
    return made.select("iso_id", "region", F.transform("parts", lambda p: p["z"]).alias("z"), F.when(in_range, dense).otherwise(False).alias("dense"))


def checked(profiles: DataFrame, regions: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) profiles by density and length; strict raises if any is rejected."""
    sized = profiles.join(F.broadcast(regions.select("region", "disp_count")), "region")
    ok = F.col("dense") & (F.size("z") == F.col("disp_count"))
    rejected = sized.where(~ok)
    if strict and not rejected.isEmpty():
        raise ValueError("some profiles have gaps or another length than their region")
    return sized.where(ok).drop("dense"), rejected


def by_region(profiles: DataFrame) -> DataFrame:
    """(iso_id, z: map region -> array), the form at the edge of the library."""
    return profiles.groupBy("iso_id").agg(F.map_from_entries(F.collect_list(F.struct("region", "z"))).alias("z"))


def split_regions(raw: DataFrame, vector: str, widths: dict[str, int]) -> DataFrame:
    """(iso_id, region, disp_count, z): consecutive slices of one raw vector, each z-scored; rows without variance are left out."""
    parts, at = [], 1
    for region, width in widths.items():
        z = zscore(F.slice(F.transform(vector, lambda x: x.cast("double")), at, width))
        parts.append(F.struct(F.lit(region).alias("region"), F.lit(width).alias("disp_count"), z.alias("z")))
        at += width
    return raw.select("iso_id", F.explode(F.array(*parts)).alias("p")).select("iso_id", "p.*").where("z is not null")


def wide(profiles: DataFrame, regions: list[str]) -> DataFrame:
    """(iso_id, z: array of the regions' arrays in the order given) of entities that have all of them."""
    found = profiles.where(F.col("region").isin(regions)).groupBy("iso_id").agg(F.map_from_entries(F.collect_list(F.struct("region", "z"))).alias("m"))
    return found.where(F.size("m") == len(regions)).select("iso_id", F.array(*[F.element_at("m", F.lit(r)) for r in regions]).alias("z"))


def exact_sample(rows: DataFrame, n: int | str, key: str = "iso_id", seed: int = 1) -> DataFrame:
    """n rows, or "All": the first by the md5 of key and seed, then by key. Same sample whatever the partitions.

    The last row of the sample is found by radix selection: counts of four hexadecimal digits at a time, until the digits of the cut have SELECTED rows or fewer, of
    which alone the order is looked at. The sample is then a filter, of any size, without a shuffle; only rows that repeat the last key are cut one by one.
    """
    if n == "All":
        return rows
    n = int(n)
    mark = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    marks, prefix, before = rows.select(mark.alias("m"), F.col(key).alias("k")), "", 0
    while True:
        digits = len(prefix) + RADIX
        counts = marks.where(F.col("m").startswith(prefix)).groupBy(F.substring("m", 1, digits).alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect()  # 16^RADIX rows
        for r in counts:
            if before + r.c > n:
                prefix, here = r.p, r.c
                break
            before += r.c
        else:
            # Only at the first digits: the sample is all rows that have a key, and of those without one what is left of n.
            return rows.where(mark.isNotNull()).unionByName(rows.where(mark.isNull()).limit(max(0, n - before)))
        if here <= SELECTED or len(prefix) == 32:
            break
    if before == n:
        return rows.where(mark < prefix)
    last = marks.where(F.col("m").startswith(prefix)).orderBy("m", "k").limit(n - before).agg(F.max(F.struct("m", "k")).alias("last")).first()["last"]
    value = F.lit(last.k)
    inside = (mark < last.m) | ((mark == last.m) & (F.col(key) < value))
    equal = (mark == last.m) & (F.col(key) == value)
    held = rows.where(inside).count()
    return rows.where(inside).unionByName(rows.where(equal).limit(n - held)) if rows.where(equal).count() > n - held else rows.where(inside | equal)


def replicate_pairs(prints: DataFrame, print_vectors: DataFrame, regions: DataFrame, at_most: int = 10) -> DataFrame:
    """(region, iso_id, p1, p2, pearson): pairs of the newest valid prints of a group, p1 < p2.

    The cap of prints comes before the join, so a group gives at_most * (at_most - 1) / 2 pairs however many prints it has.
    print_vectors(print_id, z) need no further z-scoring; regions(region, disp_count).
    """
    newest = newest_valid(prints, at_most).select("print_id", "iso_id", "region").join(print_vectors, ["print_id", "region"])
    a = newest.select("iso_id", "region", F.col("print_id").alias("p1"), F.col("z").alias("za"))
    b = newest.select("iso_id", "region", F.col("print_id").alias("p2"), F.col("z").alias("zb"))
    pairs = a.join(b, ["iso_id", "region"]).where("p1 < p2").join(F.broadcast(regions.select("region", "disp_count")), "region")
    return pairs.select("region", "iso_id", "p1", "p2", pearson("za", "zb", F.col("disp_count")).alias("pearson"))
