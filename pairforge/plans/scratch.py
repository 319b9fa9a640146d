"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session of one machine may go without: it gets a temporary folder, removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pairforge-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[Scratch] = []


def clear_scratch() -> None:
    """Delete the tables of all jobs so far; for the end of a session, before spark.stop()."""
    while _made:
        _made.pop().clear()


class Scratch:
    """Parquet tables under one folder of a job. A lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/pairforge-{uuid.uuid4().hex}"
        self.n = 0
        _made.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df, then read it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if path.split("://")[-1].lstrip("/").startswith(self.root.split("://")[-1].lstrip("/")):
                    self._delete(path)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(clear_scratch)
