"""Size checks and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows and bytes (as JSON); else as it is, and the join shuffles."""
    some = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    n, b = some.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else df


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a local master may do without: it gets a private folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lorequarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that were cut and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
