"""Structured Streaming forms of the job queue and of first-wins ingestion.

Both run over what is there and stop (availableNow); state is keyed, with a watermark, and output goes to a
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import STATUS
from ..plans.views import shared_folder


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet*").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream to its end into a table and return that."""
    spark = stream.sparkSession
    path = shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _transitions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A file's job: the latest status by (time, id), and how many events it has seen."""
    ts, event, status, seen = state.get if state.exists else (None, -1, None, 0)
    for rows in batches:
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            seen += 1
            if ts is None or (r.ts.value, r.event_id) >= (ts, event):
                ts, event, status = r.ts.value, int(r.event_id), r.status
    state.update((ts, event, status, seen))
    yield pd.DataFrame({"file_id": [key[0]], "id": [event], "status": [status], "seen": [seen]})


def stream_job_state(spark: SparkSession, sf: str) -> DataFrame:
    """Every update of every job; the highest `seen` of a file is its present state."""
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    e = events(spark, sf).select("event_id", "ts", F.col("user_id").alias("file_id"), status.alias("status"))
    updates = e.groupBy("file_id").applyInPandasWithState(_transitions, "file_id long, id long, status string, seen long", "ts long, event long, status string, seen long", "append", GroupStateTimeout.NoTimeout)
    found = finished(updates)
    return found.groupBy("file_id").agg(F.max_by(F.struct("id", "status"), "seen").alias("x"), F.max("seen").alias("seen")).select("file_id", "x.id", "x.status", "seen")


def stream_ingest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each (user, type, hour) within an hour's watermark, counted by type."""
    e = events(spark, sf).withWatermark("ts", "1 hour").withColumn("hour", F.window("ts", "1 hour").start)
    first = e.dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"]).select("event_type", "user_id", "hour")
    return finished(first).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by type and day; late ones count within the watermark of a day.

    Every trigger writes the windows that it changed to a table, with its number; the last write of a window holds.
    """
    e = events(spark, sf).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    path = shared_folder(spark)

    def write(rows: DataFrame, number: int) -> None:
        # A folder for each trigger: a trigger that runs again replaces what it wrote.
        rows.select(F.col("day.start").cast("date").alias("day"), "event_type", "n", F.lit(number).alias("trigger")).write.mode("overwrite").parquet(f"{path}/out/t{number}")

    query = e.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema("day date, event_type string, n long, trigger int").option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return written.groupBy("day", "event_type").agg(F.max_by("n", "trigger").alias("n"))


QUERIES = {f.__name__: f for f in (stream_job_state, stream_ingest_dedup, stream_windowed_counts)}

ORACLES = {
    "stream_job_state": """WITH j AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'canceled' END AS status,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS seen FROM events) SELECT user_id AS file_id, event_id AS id, status, seen FROM j WHERE r = 1""",
    "stream_ingest_dedup": "SELECT event_type, count(DISTINCT (user_id, date_trunc('hour', ts))) AS n FROM events GROUP BY event_type",
    "stream_windowed_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
