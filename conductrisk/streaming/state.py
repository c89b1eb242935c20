"""State tables that micro-batches keep in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk.sources.readers import delete, exists


class KeyedState:
    """The newest row of each key. A batch writes only the keys it touched; every `every` batches the table is written whole.

    Batch n owns the folder n and overwrites it when it is repeated, from the same earlier folders. Reading takes the last whole
    table and the folders since, so neither a batch nor a read grows with the number of batches. Folders that no batch can ask
    for any more are deleted. A missing folder is an error: keys would be lost without it.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, every: int = 16):
        self.spark, self.base, self.key, self.every = spark, base, key, every

    def _folder(self, batch_id: int) -> str:
        return f"{self.base}/batch_id={batch_id}"

    def before(self, batch_id: int) -> DataFrame | None:
        """The state when batch `batch_id` starts; None before the first."""
        if batch_id == 0:
            return None
        whole = (batch_id - 1) // self.every * self.every
        for n in range(whole, batch_id):
            if not exists(self.spark, self._folder(n)):
                raise RuntimeError(f"state of batch {n} is missing in {self.base}")
        parts = self.spark.read.option("basePath", self.base).parquet(*[self._folder(n) for n in range(whole, batch_id)])
        return self._newest(parts)

    def _newest(self, parts: DataFrame) -> DataFrame:
        names = [c for c in parts.columns if c != "batch_id"]
        return parts.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch_id").alias("v")).select("v.*")

    def write(self, touched: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % self.every == 0:
            old = self.before(batch_id)
            both = old.withColumn("batch_id", F.lit(0)).unionByName(touched.withColumn("batch_id", F.lit(1)))
            touched = self._newest(both)
        touched.write.mode("overwrite").parquet(self._folder(batch_id))
        if batch_id % self.every == 0:
            for n in range(max(0, batch_id - 2 * self.every), batch_id - self.every):
                if exists(self.spark, self._folder(n)):
                    delete(self.spark, self._folder(n))
