"""What the operators share: scratch tables, document keys, small text helpers."""

from __future__ import annotations

import gc
import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured and the master is this very machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; a lost executor then costs only its own tasks."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more: all that was made of them has been written itself."""
    for df in dfs:
        if path := getattr(df, "_docloom_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more are deleted when the driver collects its garbage; a long chain of small steps asks for that now and then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    """128 bits that name a text (null as empty); wide enough for tens of billions of texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
