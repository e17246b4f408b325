"""State between micro-batches as a small table.

Ordered operators (running counts, last-n sums, profiles, pointers) are window
computations in batch form, which a streaming query cannot run. Each micro-batch
therefore runs the batch operator, with its skew handling, and goes on from a
table the previous micro-batch left in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH = "_tw_batch"


class CarriedTable:
    """Two folders in turn: batch n reads what batch n-1 wrote and overwrites the
    other one. A batch that is run again finds its own input unchanged."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark = spark
        self.path = path.rstrip("/")
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        self.schema = schema

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/turn={batch_id % 2}"

    def read(self, batch_id: int) -> DataFrame:
        """What the batch before ``batch_id`` left; empty for the first one."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField(_BATCH, T.LongType())])
        rows = self.spark.read.schema(stored).parquet(self._folder(batch_id - 1))
        return rows.filter(F.col(_BATCH) == batch_id - 1).drop(_BATCH)

    def write(self, df: DataFrame, batch_id: int) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        (df.select(*columns, F.lit(batch_id).cast("long").alias(_BATCH))
         .write.mode("overwrite").parquet(self._folder(batch_id)))
