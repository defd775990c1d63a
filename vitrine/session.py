"""Session defaults for tests and benchmarks, and the shared scratch folder.

Every operator takes DataFrames and never builds a session of its own; a
cluster job passes the session it already has.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vitrine")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine, because
    executors on other hosts could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="vitrine-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; all paths of an application lie in one folder, to be dropped after the job."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where one result feeds several branches: the table survives the loss
    of an executor, is column-pruned on every read, and gives the optimizer a
    true size for its broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one job stores in the shared folder, and drops once later tables hold what they were read for."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch_path(spark, name)
        self.stored: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialise``."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.stored.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no DataFrame still to be computed reads."""
        for _, path in [x for x in self.stored if any(x[0] is t for t in tables)]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.stored = [x for x in self.stored if not any(x[0] is t for t in tables)]

    def drop_others(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*[t for t, _ in self.stored if not any(t is x for x in tables)])


def input_state(spark: SparkSession, path: str) -> tuple:
    """Number, size, times and names of the files under ``path`` as one row; another state means other data.

    Spark lists the files and sums what it finds; none is opened.
    """
    files = spark.read.format("binaryFile").load(path)
    names = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(names)).first())


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def still_stored(df: DataFrame) -> bool:
    """Whether the files of a materialised table are still there."""
    files = df.inputFiles()
    return bool(files) and exists(df.sparkSession, files[0])
