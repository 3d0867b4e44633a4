"""Session settings the jobs rely on, and where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # log times are UTC epoch milliseconds
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys (a busy item, a busy customer) are split at run time, also
    # where the split costs one more exchange further up the plan
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole texts are handed to Python in batches of a few MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


# fixed when the session is built; without it every column call records its call site
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """With these settings; those of before come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        # one JVM, one disk: a folder of its own for this session
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles whose plans are done: it does when the driver collects its garbage, whenever that is."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from there.

    What has been written does not change when an executor is lost, also where a
    value depends on the run (partition numbers); and several readers share one
    evaluation. One job, unlike ``checkpoint()``, which evaluates twice; and readers
    take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tillroll/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
