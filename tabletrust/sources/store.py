"""Tables in versioned folders behind one small pointer.

Rows lie in buckets by a hash of their keys. A change writes only the buckets that it touches, into a folder of its own, and
then a new pointer that names each bucket's folder; the pointer with the largest number counts. So there is no moment
without a table, a broken write changes nothing, readers keep what they have resolved, and the generation before can be taken
back. Of two writers at once the second gets an error, as its pointer's number is taken.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
POINTERS = "_pointers"


def _path(spark: SparkSession, name: str) -> tuple[Any, Any]:
    """A path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, fs = _path(spark, f"{root}/{POINTERS}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []


def _pointer(spark: SparkSession, root: str, number: int) -> dict:
    row = spark.read.text(f"{root}/{POINTERS}/{number:012d}", wholetext=True).first()
    return json.loads(row.value)


def _point(spark: SparkSession, root: str, number: int, now: dict, before: dict | None) -> None:
    """Writes a pointer: whole under another name, then renamed to a number that must be free."""
    spare, fs = _path(spark, f"{root}/{POINTERS}/spare-{uuid.uuid4().hex}")
    out = fs.create(spare, False)
    out.write(bytearray(json.dumps({"now": now, "before": before}).encode()))
    out.close()
    final, _ = _path(spark, f"{root}/{POINTERS}/{number:012d}")
    if fs.exists(final) or not fs.rename(spare, final):
        fs.delete(spare, False)
        raise RuntimeError(f"{root}: another writer was first; read the table and try again")


def exists(spark: SparkSession, root: str) -> bool:
    return bool(_numbers(spark, root))


def _rows(spark: SparkSession, root: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    paths = [f"{root}/{folder}/{BUCKET}={b}" for b, folder in state["at"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, generation: str = "now") -> DataFrame:
    """The rows of the current generation, or of the one before."""
    state = _pointer(spark, root, _numbers(spark, root)[-1])[generation]
    if state is None:
        raise ValueError(f"{root} has no generation before")
    return _rows(spark, root, state)


def _write(df: DataFrame, root: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Writes the rows by bucket into a folder of its own; the folder of each bucket that has rows."""
    folder = f"data-{uuid.uuid4().hex}"
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0)
    df.withColumn(BUCKET, at.cast("int")).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    where, fs = _path(df.sparkSession, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return {n.removeprefix(f"{BUCKET}="): folder for n in names if n.startswith(f"{BUCKET}=")}


def publish(df: DataFrame, root: str, keys: list[str] | None = None, buckets: int = 1) -> None:
    """The rows become the table's current generation; the one until now stays as the one before."""
    spark, numbers, keys = df.sparkSession, _numbers(df.sparkSession, root), keys or []
    before = _pointer(spark, root, numbers[-1])["now"] if numbers else None
    state = {"schema": df.schema.jsonValue(), "keys": keys, "buckets": buckets, "at": _write(df, root, keys, buckets)}
    _point(spark, root, numbers[-1] + 1 if numbers else 0, state, before)


def rollback(spark: SparkSession, root: str) -> bool:
    """Swaps the current generation and the one before; a second call swaps back. False without one before."""
    numbers = _numbers(spark, root)
    state = _pointer(spark, root, numbers[-1]) if numbers else {"before": None}
    if state["before"] is None:
        return False
    _point(spark, root, numbers[-1] + 1, state["before"], state["now"])
    return True


def change(spark: SparkSession, root: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, by: str | None = None) -> int:
    """Takes rows in by key (the last by `by`, else the new one) and rows with the keys of `deletes` out; returns how many
    buckets were written. Only buckets with a changed key are read and written. Null keys are keys like others."""
    numbers = _numbers(spark, root)
    state = _pointer(spark, root, numbers[-1])["now"]
    keys, n = state["keys"], state["buckets"]
    hashed = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    touched = sorted({r[0] for x in (upserts, deletes) if x is not None for r in x.select(hashed.alias("b")).distinct().collect()})  # one number a bucket
    if not touched:
        return 0
    rows = _rows(spark, root, state, touched)
    names = rows.columns
    order = [F.col(by)] if by else []
    both = rows.withColumn("_new", F.lit(0))
    if upserts is not None:
        both = both.unionByName(upserts.select(*names).withColumn("_new", F.lit(1)))
    kept = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order, F.col("_new"))).alias("_r")).select("_r.*")
    if deletes is not None:
        gone = deletes.select(*(F.col(k).alias(f"_d{i}") for i, k in enumerate(keys))).distinct()
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & kept[k].eqNullSafe(F.col(f"_d{i}"))
        kept = kept.join(gone, same, "left_anti")
    made = _write(kept, root, keys, n)
    at = {b: f for b, f in state["at"].items() if int(b) not in touched} | made
    _point(spark, root, numbers[-1] + 1, state | {"at": at}, state)
    return len(touched)
