"""Daily activity graph of users and kinds of events, kept up to date.

Each run takes only the event files that no earlier run has seen (a file stream
with a checkpoint, until all of them are read), adds their counts as deltas, and
then writes anew the days that deltas newer than the mark touch. Late events are
counted on their own day, however old. Below the target folder:

``deltas``      counts of each micro-batch, partitioned by batch; a batch that is
                run again after a failure replaces its own
``edges``       (day, src, dst, weight), partitioned by day; days are replaced whole
``mark``        the last batch whose deltas are in ``edges``
``checkpoint``  the stream's own

A run that stops anywhere is made good by the next one: deltas are replaced by
batch, days are summed from all their deltas, and the mark moves last.

    spark-submit --py-files weftgraph.zip,jobs.zip jobs/activity_graph.py --input DIR --output DIR [--config FILE]
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, read_if_there
from weftgraph.streaming.edges import windowed_activity

ZONE = "spark.sql.session.timeZone"
EDGES = "src bigint, dst string, weight bigint, day string"
DELTAS = "day string, src bigint, dst string, weight bigint, batch bigint"
MARK = "batch bigint"


def take_new(spark: SparkSession, source: str, target: str, settings: dict) -> None:
    """Count what is new in the events, one micro-batch after the other."""
    path = f"{source.rstrip('/')}/events.parquet"
    known = spark.read.parquet(path).select("ts", "user_id", "event_type").schema
    stream = spark.readStream.schema(known).option("maxFilesPerTrigger", settings["files_at_once"]).parquet(f"{path}*")

    def count(batch: DataFrame, number: int) -> None:
        counted = windowed_activity(batch.where("ts is not null"), settings["width"])
        delta = counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "src", "dst", "weight", F.lit(number).cast("bigint").alias("batch"))
        delta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/deltas")
        log.info("batch %s of %s counted", number, path)

    query = stream.writeStream.foreachBatch(count).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def refresh(spark: SparkSession, target: str) -> int:
    """Sum anew the days of deltas beyond the mark; returns how many days were written."""
    deltas = read_if_there(spark, f"{target}/deltas", DELTAS)
    if deltas is None:
        return 0
    mark = read_if_there(spark, f"{target}/mark", MARK)
    before = -1 if mark is None else mark.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    now = deltas.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    if now <= before:
        return 0
    touched = deltas.where(F.col("batch") > before).select("day").distinct()
    whole = deltas.join(touched, "day", "left_semi").groupBy("day", "src", "dst").agg(F.sum("weight").alias("weight"))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{target}/edges")
    days = touched.count()
    spark.range(1).select(F.lit(now).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{target}/mark")
    return days


def run(spark: SparkSession, source: str, target: str, settings: dict) -> str:
    """Bring the graph below ``target`` up to the events below ``source``; returns its path.

    Events without a time are left out; null users and kinds are vertices of
    their own. Events that are in the input twice count twice. Nothing new
    leaves everything as it is, no events at all leave nothing.
    """
    target = target.rstrip("/")
    zone = spark.conf.get(ZONE)
    spark.conf.set(ZONE, "UTC")  # event times have no zone: days are theirs, not the session's
    try:
        log.info("reading %s/events.parquet", source.rstrip("/"))
        take_new(spark, source, target, settings)
        days = refresh(spark, target)
        log.info("wrote %s days of %s/edges", days, target)
    finally:
        spark.conf.set(ZONE, zone)
    return f"{target}/edges"


def read(spark: SparkSession, target: str) -> DataFrame:
    """(day, src, dst, weight) as it stands; empty before the first event."""
    found = read_if_there(spark, f"{target.rstrip('/')}/edges", EDGES)
    return (spark.createDataFrame([], EDGES) if found is None else found).select("day", "src", "dst", "weight")


#: What the job's edges are once all events have been taken.
ORACLE = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS src, event_type AS dst, count(*) AS weight FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3"

if __name__ == "__main__":
    command_line(__file__, __doc__.splitlines()[0], run)
