"""Session settings and the few helpers that depend on them."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def _temporary(prefix: str) -> str:
    """A folder of this machine that is removed when the process ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, memory: str = "16g", name: str = "catalens") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("CATALENS_CHECKPOINT_DIR") or _temporary("catalens-checkpoint-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a notebook) gets a temporary folder of this machine, which goes with the process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or _temporary("catalens-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Spreads the rows over the cores if the files or the checkpoint behind ``df`` come in fewer pieces than that.

    Costly Python stages over one or two small files would otherwise run on one core; larger inputs are already split by
    ``spark.sql.files.maxPartitionBytes`` and pass unchanged, without a shuffle. Only the plan's leaves are looked at
    (sizes of files, partitions of a checkpoint), so nothing is executed. Rows are dealt out in turn, not by key, so a hot
    key is spread like any other."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    most, least = (int(re.match(r"\d+", spark.conf.get(f"spark.sql.files.{key}")).group()) for key in ("maxPartitionBytes", "openCostInBytes"))
    leaves, pieces = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            pieces += leaf.rdd().getNumPartitions()
        else:
            pieces += int(leaf.stats().sizeInBytes()) // min(most, max(least, 1)) + 1
    return df if pieces >= want else df.repartition(want)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(_temporary("catalens-"), "catalens_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
