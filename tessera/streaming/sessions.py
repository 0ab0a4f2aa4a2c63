"""Running the session stream: a folder of event files in, the last state of each session out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sessions import session_stream
from tessera.sources.tables import ensure_checkpoint_dir


def run_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Reads what is there (available-now), writes each batch's states to the shared folder and gives the last of each session. State
    and offsets are checkpointed, so a lost executor costs a retry of its tasks only."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stored = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    one_file = [x.rpartition("/")[2] for x in stored.inputFiles()] == [name]
    reader = spark.readStream.schema(stored.schema)
    events = reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)  # a stream's source is a folder

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch_no={number}")

    query = session_stream(events).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(f"{base}/out").drop("batch_no")
    return states.groupBy("session_id").agg(F.max_by(F.struct("n_calls", "tokens", "longest_streak"), F.struct("batch", "n_calls")).alias("s")).select("session_id", "s.*")
