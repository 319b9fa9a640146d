"""Joins whose left side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS, hint: str | None = None) -> DataFrame:
    """left join right on `on`; right has few rows a key. A hot key of left is dealt to `salts` partitions.

    Right is repeated `salts` times, so it should be the narrower table. how: inner or left.
    hint: a join hint for right, such as merge where its growth rules a broadcast out.
    """
    others = [F.col(c) for c in left.columns if c not in on] or [F.monotonically_increasing_id()]
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
    name = "_salt"
    while name.lower() in {c.lower() for c in [*left.columns, *right.columns]}:
        name = "_" + name
    a = left.withColumn(name, salt)
    b = right.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    b = b.hint(hint) if hint else b
    return a.join(b, [*on, name], how).drop(name)


#: A key with more rows than this is hot; so many of them are looked for, with a sketch of TRACKED counts.
HOT_ROWS, HOT_KEYS, TRACKED = 200_000, 1000, 8192


def hot_keys(rows: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """(_key, _times): hashes of keys with more than hot_rows rows, and to how many partitions each is to be dealt. One pass, in which tasks send a sketch of bounded size each; HOT_KEYS rows at most.

    Counts are estimates from above, so no key that is much hotter than its neighbours is missed, and one too many costs a few copies.
    """
    hot_rows = hot_rows or HOT_ROWS
    key = F.xxhash64(*on)
    top = rows.select(key.alias("_k")).agg(F.expr(f"approx_top_k(_k, {HOT_KEYS}, {TRACKED})").alias("t"))
    found = [(r["item"], -(-r["count"] // hot_rows)) for r in top.first().t or [] if r["item"] is not None and r["count"] > hot_rows]
    return rows.sparkSession.createDataFrame(found, "_key long, _times long")


def spread(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with _salt: hot keys of left are dealt over their _times partitions, and right's rows of these keys alone are repeated."""
    others = [F.col(c) for c in left.columns if c not in on] or [F.monotonically_increasing_id()]
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    times = F.coalesce("_times", F.lit(1))
    a = left.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left").withColumn("_salt", F.pmod(F.xxhash64(*others), times)).drop("_key", "_times")
    b = right.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("_key", "_times")
    return a, b


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """left join right on `on`; right has few rows a key. Without hot keys it is a plain join, and nothing is repeated.

    left's keys are counted first, or those of `counted`, a kept table with the same keys, if left itself is costly.
    """
    hot = hot_keys(left if counted is None else counted, on, hot_rows)
    if hot.isEmpty():
        return left.join(right, on, how)
    a, b = spread(left, right, on, hot)
    return a.join(b, [*on, "_salt"], how).drop("_salt")
