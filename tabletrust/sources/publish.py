"""Publishing tables with one generation of rollback, keyed upserts, logs, exports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletrust.functions.text import humanize


#: The temporary folder of each local session; it goes when Python ends.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where both are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _own:
        made = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tabletrust-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + _own[spark.sparkContext.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read from there: what reads them several times computes them once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, table: str) -> None:
    """Builds a staging table, then swaps names; the old table stays as <table>_previous. A failed build changes nothing."""
    spark, staging = df.sparkSession, f"{table}_staging_{uuid.uuid4().hex[:8]}"
    repair(spark, table)
    df.write.saveAsTable(staging)
    if spark.catalog.tableExists(table):
        dropped = f"{table}_dropped_{uuid.uuid4().hex[:8]}"
        if spark.catalog.tableExists(f"{table}_previous"):
            spark.sql(f"ALTER TABLE {table}_previous RENAME TO {dropped}")
        spark.sql(f"ALTER TABLE {table} RENAME TO {table}_previous")
        spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
        spark.sql(f"DROP TABLE IF EXISTS {dropped}")  # the oldest generation goes last
    else:
        spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")


def repair(spark: SparkSession, table: str) -> bool:
    """After a swap that broke off between its renames there is a previous table and no current one: it becomes current again."""
    if spark.catalog.tableExists(table) or not spark.catalog.tableExists(f"{table}_previous"):
        return False
    spark.sql(f"ALTER TABLE {table}_previous RENAME TO {table}")
    return True


def rollback(spark: SparkSession, table: str) -> bool:
    """Swaps the current and the previous generation; a second call swaps back. False without a previous one."""
    if not (spark.catalog.tableExists(f"{table}_previous") and spark.catalog.tableExists(table)):
        return False
    spare = f"{table}_swap_{uuid.uuid4().hex[:8]}"
    for old, new in ((table, spare), (f"{table}_previous", table), (spare, f"{table}_previous")):
        spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    return True


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the largest `by` of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), by).alias("_r")).select("_r.*")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows of both, the latest of each key."""
    return latest(current.unionByName(changes), keys, by)


def invalidate(df: DataFrame, table: str, column: str = "table_name") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(table))


def delete_metric(metrics: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The other metrics, and whether the named one was there."""
    return metrics.where(~F.col("metric_name").eqNullSafe(name)), not metrics.where(F.col("metric_name") == name).isEmpty()


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with readable headers: avg_price becomes Avg Price."""
    df.toDF(*map(humanize, df.columns)).write.option("header", True).csv(path)


def capped(df: DataFrame, n: int = 200) -> tuple[DataFrame, bool]:
    """At most n rows, and whether there were more. The query runs once; n is small."""
    rows = df.limit(n + 1).collect()
    return df.sparkSession.createDataFrame(rows[:n], df.schema), len(rows) > n


def ingestion_registry(attempts: DataFrame) -> DataFrame:
    """Per url: first and last fetch, number, latest folder, status and error. attempts: url, ts, status, error, folder."""
    out = attempts.groupBy("url").agg(
        F.min("ts").alias("first_fetched_at"), F.max("ts").alias("last_fetched_at"), F.count(F.lit(1)).alias("fetch_count"),
        F.max_by(F.struct("status", "error", "folder"), F.struct("ts", "status")).alias("_l"),
    )
    return out.select("url", "first_fetched_at", "last_fetched_at", "fetch_count", "_l.status", F.col("_l.error").alias("last_error"), F.col("_l.folder").alias("output_folder"))


def ranked_latest(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """The n latest rows of each key, numbered from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc()))).where(F.col("rank") <= n)
