"""Tables that are written once and read by many queries, in the cluster's shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may leave it unset: then one folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyframe"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own: its plan is a scan, however long the plan was that made it, and nothing stays in memory."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def sealed(df: DataFrame, label: str) -> DataFrame:
    """As written, for rows that must not stand in a file as they are: each is encrypted with a key that only this call's
    plans hold. Files that nobody has deleted tell nothing once the session is over."""
    key = F.lit(os.urandom(16))
    packed = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    kept = written(df.select(F.aes_encrypt(packed.cast("binary"), key).alias("sealed")), label)
    opened = F.from_json(F.aes_decrypt("sealed", key).cast("string"), df.schema.simpleString())
    out = kept.select(opened.alias("row")).select("row.*")
    out.scratch_path = kept.scratch_path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "scratch_path"):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
