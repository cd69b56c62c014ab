"""Files and events as streams: the batch operators on each micro-batch, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import pattern as P
from ..operators import sequence, tape


def watch(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def watch_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as a stream, whether it is one file or a folder of parts.

    A stream's path must be a folder unless it is a pattern, so the last letter is written as one.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def grep_stream(files: DataFrame, pattern: str) -> DataFrame:
    """Matches of a bounded pattern in files (file, text) as they arrive; stateless, so any output mode will do."""
    own = files.withColumn("tokens", tape.token_array(F.col("text")))
    return sequence.lowered(own, P.parse(pattern))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch and write its rows below ``out``, one folder for each batch.

    A batch that is run again after a failure overwrites its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window of event time; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
