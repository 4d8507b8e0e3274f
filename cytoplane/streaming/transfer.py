"""Label transfer for query cells that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cytoplane.operators.transfer import transfer_labels

ARRIVING = "id bigint, vec array<double>"


def read_arriving(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Query vectors as their Parquet files land in a folder."""
    reader = spark.readStream.schema(ARRIVING)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def transfer_arriving(
    arriving: DataFrame, refs: DataFrame, k: int, out: str, checkpoint: str
) -> StreamingQuery:
    """Vote on every micro-batch against a fixed reference.

    Each batch owns one directory below ``out``; a batch that is run again
    after a failure replaces its own rows, so results appear once.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = transfer_labels(batch, refs, k)
        found.write.mode("overwrite").parquet(f"{out}/part={number}")

    return (
        arriving.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
