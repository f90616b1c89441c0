"""A store of facts as partitioned Parquet: snapshots, writes that can be repeated, and publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import checked, conform, empty, schema


class FactStore:
    """Tables under one folder. Facts are partitioned by snapshot (or repository), so each write replaces whole
    partitions: running it again, or after a failure, gives the same table. A snapshot counts from when its row says
    ``ready``, and that row is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, snapshot: str | None = None) -> DataFrame:
        """A table, or the part of one snapshot; by partition, so other snapshots aren't opened."""
        if not self.exists(table):
            return empty(self.spark, table)
        df = self.spark.read.schema(schema(table)).parquet(self.path(table))
        return df.filter(F.col("snapshot_uid") == snapshot) if snapshot is not None else df

    def replace(self, table: str, df: DataFrame, by: tuple[str, ...] = ("snapshot_uid",)) -> None:
        """Replace the partitions that ``df`` has rows in: by snapshot, by snapshot and kind, or by repository."""
        rows = checked(conform(df, table), table)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(table))

    def append(self, table: str, df: DataFrame, by: tuple[str, ...] = ("snapshot_uid",)) -> None:
        checked(conform(df, table), table).write.mode("append").partitionBy(*by).parquet(self.path(table))

    def upsert(self, table: str, new: DataFrame, keys: list[str], by: tuple[str, ...]) -> None:
        """Rows of equal keys take the new values; only partitions of new rows are written."""
        from ..operators.incremental import upsert

        new = conform(new, table).dropDuplicates(keys)
        touched = new.select(*by).distinct()
        old = self.read(table).join(touched, list(by), "left_semi")
        merged = upsert(old, new, keys)
        # The old partitions are read while new ones are written, so what is read is cut off first.
        self.replace(table, self._apart(merged, table), by)

    def _apart(self, df: DataFrame, table: str) -> DataFrame:
        """Write elsewhere under the store and read back: survives lost executors, unlike what an executor holds."""
        path = f"{self.root}/_staging/{table}-{uuid.uuid4().hex}"  # its own, so that two writers don't meet
        df.write.parquet(path)
        return self.spark.read.schema(schema(table)).parquet(path)

    def latest(self, repo: str) -> str | None:
        """The newest ready snapshot of a repository."""
        rows = self.read("snapshots").filter((F.col("repo_uid") == repo) & (F.col("status") == "ready"))
        found = rows.agg(F.max(F.struct("created_at", "snapshot_uid"))["snapshot_uid"]).first()
        return found[0] if found else None

    def publish(self, snapshot: dict) -> None:
        """Write the snapshot's row as ready, after all its facts, with counts of what is stored."""
        uid = snapshot["snapshot_uid"]
        counts = {"files_total": self.read("file_versions", uid).count(), "nodes_total": self.read("nodes", uid).count(), "edges_total": self.read("edges", uid).count()}
        row = {f.name: None for f in schema("snapshots")} | snapshot | counts | {"status": "ready"}
        self.replace("snapshots", self.spark.createDataFrame([tuple(row.values())], schema("snapshots")))

    def fail(self, snapshot: dict) -> None:
        row = {f.name: None for f in schema("snapshots")} | snapshot | {"status": "failed"}
        self.replace("snapshots", self.spark.createDataFrame([tuple(row.values())], schema("snapshots")))


def latest_ready(snapshots: DataFrame) -> DataFrame:
    """repo_uid, snapshot_uid of the newest ready snapshot of each repository."""
    return snapshots.filter("status = 'ready'").groupBy("repo_uid").agg(F.max(F.struct("created_at", "snapshot_uid"))["snapshot_uid"].alias("snapshot_uid"))


def find_repos(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """ref and the repositories that it names by uid, name or root path; equality joins, so no request scans them all."""
    forms = F.array_distinct(F.array("repo_uid", "name", "root_path"))
    return requests.select("ref").distinct().join(repos.select(F.explode(forms).alias("ref"), "repo_uid", "name", "root_path"), "ref")


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """snapshot_uid and a count for each table, 0 where it has no rows."""
    long = None
    for name, df in tables.items():
        part = df.groupBy("snapshot_uid").agg(F.count("*").alias("_n")).withColumn("_t", F.lit(name))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("snapshot_uid").agg(*(F.coalesce(F.sum(F.when(F.col("_t") == n, F.col("_n"))), F.lit(0)).alias(n) for n in tables))


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that was written last."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def envelope(df: DataFrame, command: str, repo: str, snapshot: str, stale: bool = False) -> DataFrame:
    """One JSON object for each row: the command's name, repository and snapshot beside the row itself."""
    return df.select(F.to_json(F.struct(F.lit(command).alias("command"), F.lit(repo).alias("repo"), F.lit(snapshot).alias("snapshot"), F.lit(stale).alias("stale"), F.struct("*").alias("result"))).alias("json"))
