"""Staging as a stream: landed files are the source and the checkpoint is the memory of what was staged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import stage
from ..sources.csv_feed import LANDING_SCHEMA, read_receipts


def landing_stream(spark: SparkSession, landing_root: str) -> DataFrame:
    columns = [c.split()[0] for c in LANDING_SCHEMA.split(", ")]
    return spark.readStream.schema(LANDING_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{landing_root}/landing/listing_outcome").select(*columns)


def stage_available(spark: SparkSession, landing_root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Stage what has landed since the last call and end; a call with nothing new appends nothing."""
    rows = stage(landing_stream(spark, landing_root), read_receipts(spark, landing_root))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
