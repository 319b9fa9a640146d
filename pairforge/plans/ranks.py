"""Running sums and ranks over rows that are dealt to partitions by ranges of their order.

A partition holds a range of (group, order), as many as the session has shuffle partitions, so parallelism grows with the cluster and the rows, and no group is
sorted in one task, whatever its size. Each partition adds up its own rows; what lies before a partition comes from a table of one row a partition and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.plans.scratch import Scratch

#: Up to so many rows of sums go to all tasks.
SHARED = 100_000


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """rows with, for each (name: column) of sums, `name`, the column's sum over the rows of the group up to this one, and `name`_all, that over the whole group.

    Rows of equal order in a group should be one row, or be told apart by the last column of order.
    """
    placed = scratch.keep(rows.repartitionByRange(*by, *order).withColumn("_at", F.spark_partition_id()))
    own = placed.groupBy(*by, "_at").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    own = scratch.keep(own)
    before = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    starts = own.select(
        *by,
        "_at",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in sums],
    )
    inside = W.partitionBy(*by, "_at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(c).over(inside).alias(f"_run_{n}") for n, c in sums.items()])
    starts = F.broadcast(starts) if own.count() <= SHARED else starts
    found = run.join(starts, [*by, "_at"])
    return found.select(*rows.columns, *[(F.col(f"_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])
