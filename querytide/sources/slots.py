"""A table that is rewritten by every micro-batch, in a few slots that are reused in turn.

Batch n writes slot n mod SLOTS and reads what batch n - 1 wrote. A repeated batch finds its input untouched and
overwrites its own output, so repeating it changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from querytide.session import no_rows

SLOTS = 4


@dataclass(frozen=True)
class SlottedTable:
    path: str
    schema: T.StructType

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/slot={batch_id % SLOTS}"

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write the batch's rows and return them as read from storage."""
        stamped = rows.select(*self.schema.names, F.lit(batch_id).cast("bigint").alias("batch_id"))
        stamped.write.mode("overwrite").parquet(self._slot(batch_id))
        return self.read(rows.sparkSession, batch_id)

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What batch `batch_id` wrote; no rows for a batch before the first."""
        if batch_id < 0:
            return no_rows(spark, self.schema)
        stamped = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        rows = spark.read.schema(stamped).parquet(self._slot(batch_id))
        return rows.where(F.col("batch_id") == batch_id).drop("batch_id")

    def latest_batch(self, spark: SparkSession) -> int | None:
        """The latest batch that has written; none before the first."""
        try:
            rows = spark.read.schema("batch_id bigint").option("ignoreMissingFiles", "true").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.agg(F.max("batch_id")).first()[0]
