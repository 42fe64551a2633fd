"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the package expects; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(master)
        .appName("stichos")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # texts are much work for their size: small shuffles keep all cores busy too
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the Python workers of a session this package, once, where it is not installed: as an archive that Spark sends to every executor."""
    sc = spark.sparkContext
    own = os.path.dirname(os.path.abspath(__file__))
    if "site-packages" in own.split(os.sep) or getattr(sc, "_stichos", False):
        return
    archive = os.path.join(sc._temp_dir, "stichos.zip")  # Spark's own folder on the driver, from which it serves files
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(own):
            for f in sorted(files):
                if f.endswith((".py", ".json")):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(own)))
    sc.addPyFile(archive)
    sc._stichos = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are much work, spread over all cores where its files give fewer pieces than there are."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation of earlier stages.

    The folder is spark.checkpoint.dir of the session, which all executors share. A local session without one gets a temporary folder
    that goes with the process; any other session must name one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="stichos-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()
