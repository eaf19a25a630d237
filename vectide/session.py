"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; a parquet file or directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that they need no path set."""
    context = spark.sparkContext
    if getattr(context, "_vectide_shipped", False):
        return
    root = Path(__file__).resolve().parent
    made = os.path.join(tempfile.mkdtemp(prefix="vectide-"), "vectide.zip")
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(root.parent))
    context.addPyFile(made)
    context._vectide_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the master is
    local (tests, one machine) a temporary folder is taken and set on the context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vectide-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """A partition count that keeps all cores busy without tiny tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores over all cores, for stages that cost more than moving the rows; others as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
