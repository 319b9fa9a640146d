"""Entity lists and clusterings made elsewhere, from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.plans.scratch import Scratch


#: Lines of a file that one task takes in order, about.
CHUNK = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line). A large file is read by several tasks, each a split of it: a line's number is its place in the split and the number of lines in those before."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # Lines of a split are read in order, in one task.
    rows = Scratch(spark).keep(raw)
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("k", F.row_number().over(W.partitionBy("file", "split").orderBy("at"))).join(splits, ["file", "split"])
    return placed.select("file", (F.col("start") + F.col("k") - 1).alias("line_no"), "line")


def id_list(first_lines: DataFrame) -> DataFrame:
    """first_lines(line) -> (iso_id): comma separated, blanks and single quotes taken off, distinct."""
    one = first_lines.select(F.explode(F.split("line", ",")).alias("x"))
    return one.select(F.trim(F.btrim(F.trim("x"), F.lit("'"))).alias("iso_id")).distinct()


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return id_list(read_lines(spark, path).where("line_no = 0"))


def list_difference(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(status, iso_id): shared, missing (known but not listed) and extra (listed but not known)."""
    k = known.select(F.trim(F.col("iso_id").cast("string")).alias("iso_id")).distinct()
    part = lambda df, name: df.select(F.lit(name).alias("status"), "iso_id")
    return part(k.join(listed, "iso_id", "left_semi"), "shared").unionByName(part(k.join(listed, "iso_id", "left_anti"), "missing")).unionByName(part(listed.join(k, "iso_id", "left_anti"), "extra"))


def import_clusters(lines: DataFrame, known: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """lines(file, line_no, line) of sectioned CSV -> (file, cluster_ord, iso_id).

    Blank lines do not count. Rows lie after the first row that begins with Cluster Id and before the next that begins with Threshold: or is
    ******; further header rows are passed over. Rows of unknown entities are left out, and a change of id between the known rows that are left begins a
    cluster, so an id that comes again later is another cluster. Runs are counted in chunks of a file's lines, then over the chunks, so a large file is many tasks.
    """
    scratch = Scratch(lines.sparkSession)
    parsed = scratch.keep(lines.where(F.trim("line") != "").select("file", "line_no", F.from_csv("line", "id string, iso string").alias("r")).select("file", "line_no", "r.id", "r.iso"))
    is_header = F.col("id") == "Cluster Id"
    heads = parsed.where(is_header).groupBy("file").agg(F.min("line_no").alias("h"))
    ends = parsed.where(F.startswith("id", F.lit("Threshold:")) | (F.col("id") == "******")).join(heads, "file").where("line_no > h").groupBy("file").agg(F.min("line_no").alias("t"))
    limits = scratch.keep(heads.join(ends, "file", "left"))  # a row a file
    body = parsed.join(limits, "file").where((F.col("line_no") > F.col("h")) & (F.col("t").isNull() | (F.col("line_no") < F.col("t"))) & ~F.coalesce(is_header, F.lit(False)))
    ids = known.select(F.trim(F.col("iso_id").cast("string")).alias("iso_id")).distinct()
    rows = body.select("file", "line_no", F.floor(F.col("line_no") / chunk).alias("chunk"), "id", F.trim("iso").alias("iso_id")).join(ids, "iso_id", "left_semi")
    order = W.partitionBy("file", "chunk").orderBy("line_no")
    # The first row of a chunk waits for the last id of the chunk before it.
    new = F.when(F.row_number().over(order) == 1, 0).when(F.lag("id").over(order).eqNullSafe(F.col("id")), 0).otherwise(1)
    rows = scratch.keep(rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))))
    place = F.struct("line_no", "id")
    chunks = rows.groupBy("file", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.sum("new").alias("inner"))
    file = W.partitionBy("file").orderBy("chunk")
    joined = F.when(F.lag("last.id").over(file).eqNullSafe(F.col("first.id")) & (F.row_number().over(file) > 1), 0).otherwise(1)
    chunks = chunks.select("file", "chunk", "inner", joined.alias("opens"))
    before = F.coalesce(F.sum("inner").over(file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.sum("opens").over(file.rowsBetween(W.unboundedPreceding, 0)) - 1
    starts = chunks.select("file", "chunk", before.alias("before"))
    return rows.join(starts, ["file", "chunk"]).select("file", (F.col("before") + F.col("run")).cast("long").alias("cluster_ord"), "iso_id").distinct()
