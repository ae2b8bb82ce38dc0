"""Session helpers: reading tables, cutting lineage, checking sizes before a broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application; Spark hands it from the driver to every executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loamgrid-code-"), "loamgrid.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("loamgrid", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A temporary folder is made only where neither is set and Spark runs inside one process, as in tests; it is deleted
    when the process ends.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loamgrid-")
        sc.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder


def scratch(spark: SparkSession) -> str:
    """The folder of this application's tables; sweep() deletes it, when no result that reads them is needed any more."""
    return f"{shared_folder(spark)}/loamgrid-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete every table that cut() wrote in this application."""
    _delete(spark, scratch(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor costs no recomputation.

    Operators delete with drop_cut() what no result reads; what a returned, lazy result reads stays until sweep().
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles() if "/cut-" in f}:
        _delete(df.sparkSession, name)


def bounded_collect(df: DataFrame, most: int, what: str) -> list:
    """Collect at most `most` rows; more is an error, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows, too many to broadcast")
    return rows


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """Hint a broadcast only after counting; beyond `most` rows the join is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
