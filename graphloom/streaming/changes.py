"""The change stream: file events by change kind, merged batch by batch into a state table.

Each micro-batch is aggregated and appended to the state as one increment under its batch id, so a batch that runs twice
replaces its own increment; the state is the sum of increments.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.store import ensure_checkpoint_dir

STATE = "change string, file long, events long, last_epoch long, batch long"


def reconcile(spark: SparkSession, root: str, per_trigger: int = 1) -> DataFrame:
    """Runs the stream over root's events to its end and returns the state: change, file, events, last_epoch."""
    base = f"{ensure_checkpoint_dir(spark)}/changes-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{root}/events.parquet").schema

    def merge(df: DataFrame, batch: int) -> None:
        out = df.groupBy(F.col("event_type").alias("change"), (F.col("user_id") % 50).alias("file")).agg(F.count("*").alias("events"), F.max("event_id").alias("last_epoch"))
        out.write.mode("overwrite").parquet(f"{base}/state/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{root}/events.parquet*")
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    state = spark.read.schema(STATE).parquet(f"{base}/state")
    return state.groupBy("change", "file").agg(F.sum("events").alias("events"), F.max("last_epoch").alias("last_epoch"))
