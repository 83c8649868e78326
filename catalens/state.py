"""Versioned snapshots: every change writes a new set of tables and then moves one pointer.

A snapshot folder holds a Parquet folder for each table. ``CURRENT`` names the valid snapshot and is replaced in one
step, so readers see the old or the new state, and a failed write leaves only an unused folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalens import schemas as S
from catalens.operators.catalogue import Catalogue, empty


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, base: str) -> int | None:
    fs, pointer = _fs(spark, f"{base}/CURRENT")
    if not fs.exists(pointer):
        return None
    return int(spark.read.text(f"{base}/CURRENT").first()[0])


def write(catalogue: Catalogue, base: str, expected: int | None = None) -> int:
    """Writes all tables as the next version; ``expected`` guards against another writer."""
    spark = catalogue.files.sparkSession
    now = current(spark, base)
    if expected is not None and now != expected:
        raise RuntimeError(f"{base}: version is {now}, expected {expected}")
    version = (now or 0) + 1
    for name in S.SCHEMAS:
        catalogue.child(name).write.mode("overwrite").parquet(f"{base}/v{version}/{name}")
    spark.createDataFrame([(S.LAYOUT_VERSION,)], "layout int").coalesce(1).write.mode("overwrite").json(f"{base}/v{version}/_layout")
    fs, pointer = _fs(spark, f"{base}/CURRENT")
    _, fresh = _fs(spark, f"{base}/CURRENT.v{version}")
    out = fs.create(fresh, True)
    out.writeBytes(f"{version}\n")
    out.close()
    if fs.exists(pointer):
        fs.delete(pointer, False)
    fs.rename(fresh, pointer)
    return version


def read(spark: SparkSession, base: str, version: int | None = None) -> Catalogue:
    """A snapshot, the current one by default; tables of an older layout are brought to the present one."""
    version = version or current(spark, base)
    if version is None:
        return Catalogue(**{name: empty(spark, name) for name in S.SCHEMAS})
    return Catalogue(**{name: S.upgrade(spark.read.parquet(f"{base}/v{version}/{name}"), name) for name in S.SCHEMAS})


def append_analyses(analyses: DataFrame, base: str) -> None:
    """The audit log only grows: rows are appended to a folder of their own."""
    analyses.write.mode("append").parquet(f"{base}/analyses_log")
