"""Sessions, the shared work folder and ways to cut lineage that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "glyphmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; a session that exists already is used as it is."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="glyphmill-code-"), "glyphmill_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("glyphmill", os.path.relpath(full, root)))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def on_one_machine(master: str) -> bool:
    """Whether a master runs its executors in the driver's own process (local, local[8], local[*, 4]), where a folder of this machine is shared by all."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a session on one machine may go without; it gets a new temporary folder."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not on_one_machine(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        d = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back: later steps start from files that outlive any executor.

    The files are removed by ``release``, else when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed by ``release``, else when the driver ends."""
    path = os.path.join(shared_dir(spark), f"glyphmill-{name}-{uuid.uuid4().hex}")
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> int:
    """Delete all tables that ``materialize`` has written in this application so far, and say how many: for sessions of many queries, once the results
    of earlier ones have been read. Frames made from these tables can't be read any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at, files = _place(spark, path)
        files.delete(at, True)
    return len(paths)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now instead of at the driver's next collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
