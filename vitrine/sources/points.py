"""Sinks: evaluation results and the keyed, dimension-checked point table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.session import materialise, scratch_path


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation records as JSON lines; parent folders are made, old output is replaced."""
    results.write.mode("overwrite").json(path)


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep, per key, the row that is last in ``order``.

    The maximum of a struct merges partial results in every task, so a key
    holding a third of all rows reaches the shuffle as one row per task.  Rows
    equal in ``order`` are settled by a digest of their columns, which makes
    replaying a batch change nothing; maps may be among them.
    """
    rest = [c for c in rows.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    last = F.max_by(F.struct(*rest), F.struct(*order, digest))
    return rows.groupBy(key).agg(last.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Points after an upsert: new ids are added, known ones replaced.

    A stored point stays only if its version is higher than the incoming one.
    """
    both = existing.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True
    )
    return latest_by_key(both, key, [version, "_incoming"]).drop("_incoming")


def dimension_check(points: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Mark each point with its vector size and whether the collection takes it."""
    size = F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(column))
    return points.withColumn("dim", size).withColumn("accepted", F.col("dim") == dim)


class PointTable:
    """A collection of points with a fixed vector size, stored as parquet in buckets by a hash of the id.

    An upsert reads, merges and writes only the buckets that its ids fall into; the rest of
    the collection is not touched.  What each bucket's current folder is stands in a manifest
    of one row per bucket, written last: readers see all of an upsert or nothing, a failed
    write leaves the collection as it was, and what it left behind is replaced by the next
    one.  Replaying an upsert changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int, buckets: int = 64):
        self.spark, self.root, self.dim, self.buckets = spark, root.rstrip("/"), dim, buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Numbers of the manifests that were written to their end."""
        fs, folder = self._fs(), self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path("manifest", n, "_SUCCESS")))

    def manifest(self) -> dict[int, int]:
        """The number of the write that holds each bucket's points; at most one entry per bucket."""
        done = self._versions()
        if not done:
            return {}
        return {r.bucket: r.write for r in self.spark.read.parquet(f"{self.root}/manifest/{done[-1]}").collect()}

    def exists(self) -> bool:
        return bool(self._versions())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _read(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/write={w}/bucket={b}" for b, w in sorted(places.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def upsert(self, incoming: DataFrame) -> DataFrame:
        """Store the accepted points and return the rejected ones (wrong vector size)."""
        checked = dimension_check(incoming, self.dim)
        fresh = latest_by_key(checked.filter("accepted").drop("dim", "accepted"), "id", ["version"])
        fresh = materialise(fresh.withColumn("bucket", self._bucket()), "fresh-points")
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most the buckets
        places, done = self.manifest(), self._versions()
        number = done[-1] + 1 if done else 0
        if touched or not done:
            merged = fresh.drop("bucket")
            known = {b: places[b] for b in touched if b in places}
            if known:
                merged = upsert(self._read(known), merged)
            merged = merged.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/write={number}")
            places = {**places, **dict.fromkeys(touched, number)}
            rows = self.spark.createDataFrame(sorted(places.items()), "bucket int, write int")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{number}")
        return checked.filter(~F.col("accepted"))

    def vacuum(self) -> int:
        """Delete bucket folders and manifests that the newest manifest does not need; how many went."""
        places, done, fs, gone = self.manifest(), self._versions(), self._fs(), 0
        for status in fs.listStatus(self._path()) if done else []:
            name = status.getPath().getName()
            if name.startswith("write=") and int(name[6:]) <= done[-1]:
                for part in fs.listStatus(status.getPath()):
                    bucket = part.getPath().getName()
                    if bucket.startswith("bucket=") and places.get(int(bucket[7:])) != int(name[6:]):
                        gone += fs.delete(part.getPath(), True)
        for old in done[:-1]:
            gone += fs.delete(self._path("manifest", str(old)), True)
        return gone


def new_point_table(spark: SparkSession, dim: int) -> PointTable:
    return PointTable(spark, scratch_path(spark, "points"), dim)
