"""Run a stream over what is available and write its rows exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.session import fresh_path
from conductrisk.sources.readers import exists


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, name: str | None = None) -> DataFrame:
    """File stream over a folder of Parquet files, a bounded number of files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


#: Rows of a file of a replay: a batch is read by as many tasks as it has files.
FILE_ROWS = 50_000


def stage_replay(df: DataFrame, path: str, slices: int, ts: str = "date", limit: int | None = None,
                 files_per_slice: int | None = None, unit: int = 1) -> int:
    """Write a table as time-ordered files for a replay, optionally only its first rows. Rows of one `unit` (microseconds) stay together.

    A file stream reads files in the order of their modification times, so the time slices are
    written one after the other. Each slice becomes `files_per_slice` files, by default one per FILE_ROWS rows, which as many
    tasks write and read. The number is returned: let a micro-batch take whole slices (files per trigger a multiple of it).
    """
    spark = df.sparkSession
    rows = df.orderBy(ts).limit(limit) if limit else df
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / unit)
    steps = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx(at, steps, 10_000).alias("c") if steps else F.lit(None).alias("c"), F.count(F.lit(1)).alias("n")).first()
    files = files_per_slice or max(1, -(-found["n"] // (slices * FILE_ROWS)))
    edges = [None, *sorted(set(found["c"] or [])), None]
    written = _files(spark, path)
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.repartition(files).sortWithinPartitions(ts).write.mode("append").parquet(path)
        # a slice of fewer rows than files is filled up with empty files, so that slices and batches stay in step
        due, written = written + files, _files(spark, path)
        for _ in range(due - written):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
            written += 1
    return files


def _files(spark: SparkSession, path: str) -> int:
    """How many Parquet files a folder holds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return len(found) if found is not None else 0


def run_batches(stream: DataFrame, write, mode: str = "append", state: str | None = None, trigger: dict | None = None) -> None:
    """Run `write(batch, batch_id)`, by default over all available input.

    `state` is the checkpoint folder: with the same one a later run goes on where this one stopped.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", state or fresh_path(spark, "stream-state"))
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None,
                 state: str | None = None) -> DataFrame:
    """Run the stream and read its rows with their `batch_id`.

    Each micro-batch owns one folder and overwrites it, so a repeated batch leaves no duplicates.
    With the same `path` and `state` a second run adds what has come since.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, write, mode, state)
    if not exists(spark, path):
        return spark.createDataFrame([], stream.schema).withColumn("batch_id", F.lit(0).cast("int"))
    full = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(full).parquet(path)


def latest_version(spark: SparkSession, base: str) -> int:
    """The highest n of the folders v0, v1, .. in `base`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v*")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return max(int(f.getPath().getName()[1:]) for f in found)


def latest_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key of an update-mode table."""
    values = [c for c in table.columns if c not in keys and c != "batch_id"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
