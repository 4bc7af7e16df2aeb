"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: HotSpot leaves methods above 8000 bytes of code uncompiled; wide stages run split instead.
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution; on a cluster, leave master and sizing to spark-submit."""
    builder = (
        SparkSession.builder.appName("matchspark")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call-site capture per column expression: halves the time to build large plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(METHOD_LIMIT, str(METHOD_BYTES))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchspark-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Jobs inside run in methods that HotSpot compiles, in sessions of any making; the session's own limit holds after."""
    own = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(own), METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, own)


def cut(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with a short lineage.

    The table stays for later reads of the result. A loop names the table of its last
    round as ``replaces``: it is deleted once the new one is complete, if ``cut`` wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with compiled(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    old = vars(replaces).get("_cut_path") if replaces is not None else None
    if old:
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return table
