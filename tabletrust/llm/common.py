"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table may be broadcast, by the measured size of its values; beyond it, it is joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: A word: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver gets a temporary folder of its own, which goes
    when Python ends; on a cluster it is an error, as executors wouldn't see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        made = _own[context.applicationId] = tempfile.mkdtemp(prefix="tabletrust-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + _own[context.applicationId]


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabletrust-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes the folders that `saved` has written in this session. For callers whose results are written elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def value_bytes(df: DataFrame, name: str) -> Column:
    """About how many bytes a column's value takes in memory."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = 24 + F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        size = 24 + 8 * F.size(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = 24 + F.octet_length(F.to_json(F.struct(c)))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8))


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of the rows is within the bound."""
    row = sum((value_bytes(df, c) for c in df.columns), F.lit(16))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0] <= most


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast when the measured size of its rows is within the bound; df as it is otherwise."""
    return F.broadcast(df) if is_small(df, most) else df


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out from every training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(2))
