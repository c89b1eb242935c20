"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM never compiles a method of more bytes: rules with many conditions would run in its interpreter
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
START_SETTINGS = {
    **RUNTIME_SETTINGS,
    # recording a Python call site for every column makes large plans slow to build
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "conductrisk", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package expects. On a cluster leave `master` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**START_SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only where nobody named one (a laptop, a test) a temporary folder is made and remembered in
    the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder all executors can reach in spark.checkpoint.dir")
    path = spark.conf.get("conductrisk.checkpoint.dir", None)
    if path is None:
        path = tempfile.mkdtemp(prefix="conductrisk-")
        spark.conf.set("conductrisk.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; `release` removes what was written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process. Call it when the results are written.

    A result that has not been computed yet still reads its intermediate tables, so nothing is deleted before.
    """
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _MADE:
        target = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(target.getFileSystem(conf).delete(target, True))
    return gone


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where several later steps read the same expensive table: it cuts the lineage, survives
    lost executors, and the columnar copy still allows pruning and pushdown.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
