"""Session helpers: table access, and cutting lineage in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The setting in which a cluster names its shared folder.
SHARED = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postsieve")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are cores; as it is otherwise, so without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where the setting is absent and the master is local."""
    where = spark.conf.get(SHARED, None)
    if not where:
        where = spark.sparkContext.getConf().get(SHARED, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED} to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="postsieve-")
        spark.conf.set(SHARED, where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df reliably to the shared folder and go on from there; survives the loss of any executor."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, on any file system that Spark knows; one that isn't there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application; Spark serves the archive to all executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="postsieve-pkg-")) / "postsieve_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
