"""Run a stream over what is there and read what it has said last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import folder


def settled(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The last row of each key, after all that the source holds now has passed the stream.  Each batch is a table of its own, so
    a batch that runs again takes its own place."""
    path = folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/out/*")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))).where("_n = 1").drop("_n", "_batch")
