"""New files only: a file source with a checkpoint, drained once and stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, fmt: str = "parquet", prepare: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Append the rows of files not seen before to ``target``; how many batches ran.

    The checkpoint remembers files, so a second run over the same folder does nothing. Each batch
    writes a folder of its own that a repeat overwrites, so a restart leaves no rows twice.
    """
    stream = spark.readStream.schema(schema).format(fmt).option("recursiveFileLookup", "true").load(source)
    ran: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        made = prepare(batch) if prepare else batch
        made.withColumn("batch", F.lit(number)).drop("batch").write.mode("overwrite").parquet(f"{target}/batch={number}")
        ran.append(number)

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)
