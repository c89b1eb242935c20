"""How the operators of this package read and return rows.

An operator returns every input row as the struct `row` beside its own columns. So an input column
can have any name, and repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm.kernels import pieces

def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pack(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"))


def fold(modulus: int, column: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def order_key(row: str = "row") -> Column:
    """The document's place: its id, and the smallest number for a null id."""
    return F.coalesce(F.col(f"{row}.doc_id"), F.lit(-(1 << 63)).cast("long"))


def row_key(row: str = "row") -> Column:
    """Equal for rows with the same id and text."""
    return F.xxhash64(F.col(f"{row}.doc_id"), F.col(f"{row}.text"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    row = batch.column("row")
    return row.flatten()[row.type.get_field_index("text")]


def map_texts(docs: DataFrame, work: Callable, fields: list[tuple[str, T.DataType]],
              limit: int | None = None) -> DataFrame:
    """Add columns that depend on the row alone.

    `work` gets an Arrow batch with `row` and returns the new columns as a list of arrays. It is called on slices of
    bounded size.
    """
    packed = docs if docs.columns[:1] == ["row"] else pack(docs)
    schema = T.StructType([packed.schema["row"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        for batch in batches:
            for first, n in pieces(text_of(batch), *([limit] if limit else [])):
                part = batch.slice(first, n)
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(part)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *new], ["row", *(n for n, _ in fields)])
                del part, new
            # an idle worker keeps no buffers that later stages need
            pa.default_memory_pool().release_unused()

    return packed.mapInArrow(run, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)
