"""Writers: JSON lines, CSV with fixed columns, report documents. None overwrites what it reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names for checkpoints; in local mode below a folder of this machine where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lathe-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/lathe-{name}-{uuid.uuid4().hex}"


def json_lines(df: DataFrame, path: str, append: bool = False, by: list[str] = ()) -> None:
    """One file for each task; concurrent tasks need no lock."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def padded(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Exactly ``columns``: those that are missing, and nulls, as ``fill``; others are left out."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) if c in df.columns else F.lit(fill).alias(c) for c in columns))


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> bool:
    """A header and the rows, in one file: for summaries. Nothing is written without rows."""
    out = padded(df, columns) if columns else df
    if out.isEmpty():
        return False
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row, a JSON document: each part is (key, value) rows and becomes an object. For summaries."""
    found = None
    for name, df in parts.items():
        k, v = df.columns[:2]
        one = df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(k).cast("string"), F.col(v).cast("string"))))).alias(name))
        found = one if found is None else found.crossJoin(one)
    return found.select(F.to_json(F.struct(*parts)).alias("report"))


def swapped(df: DataFrame, path: str) -> None:
    """Writes beside ``path``, moves what was there to ``path.bak``, then the new in its place."""
    spark = df.sparkSession
    json_lines(df, path + ".new")
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(path + ".bak"), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(path + ".bak"))
    fs.rename(at(path + ".new"), at(path))
