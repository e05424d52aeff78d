"""Text logs followed as a stream: lines parsed in the order of their files, and where each job stands."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import textrules as tr
from voxframe.session import shared_dir


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of the text files of a folder as they arrive: value, file, written, start.

    A log grows by new files; a file that has been read is not read again.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_block_start").alias("start")]
    return reader.text(folder).select("value", *place)


class FollowedLog:
    """A folder with the parsed lines of each micro-batch; a batch that is run again replaces itself.

    ``job`` names the job that a line belongs to, from its file. Lines of a job are in the order
    of micro-batches, then of files by time and name, then of the file itself: the place of its
    split and the row in it, which one task reads in order.
    """

    ORDER = ("batch", "written", "file", "start", "row")

    def __init__(self, spark: SparkSession, job: Column, folder: str | None = None):
        self.spark, self.job = spark, job
        self.folder = folder or f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"

    def write(self, lines: DataFrame, batch: int) -> None:
        # places are taken where a split is read; the lines are then parsed by all cores, as a batch may be a few files
        placed = lines.select(self.job.alias("job"), F.lit(batch).cast("bigint").alias("batch"), "written", "file", "start", F.monotonically_increasing_id().alias("row"), "value")
        parsed = placed.repartition(lines.sparkSession.sparkContext.defaultParallelism).select(
            *placed.columns,
            tr.log_event(F.col("value")).alias("e"),
            tr.progress(F.col("value")).alias("progress"),
            tr.terminal_state(F.col("value")).alias("ending"),
        )
        parsed.write.mode("overwrite").parquet(f"{self.folder}/lines/batch_no={batch}")

    def run(self, stream: DataFrame) -> FollowedLog:
        """Take what a stream has now."""
        query = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def lines(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lines").drop("batch_no")

    def events(self) -> DataFrame:
        """Parsed events; noise and blank lines are none."""
        return self.lines().where("e.event IS NOT NULL").select("job", *self.ORDER, "e.*")

    def status(self) -> DataFrame:
        """Lines and events so far, latest progress and first terminal state of each job."""
        at = F.struct(*self.ORDER)
        moved = F.when(F.col("progress.step").isNotNull(), at)
        return self.lines().groupBy("job").agg(
            F.count(F.lit(1)).alias("lines"),
            F.count("e.event").alias("events"),
            F.max_by("progress.step", moved).alias("step"),
            F.max_by("progress.loss", moved).alias("loss"),
            F.coalesce(F.min_by("ending", F.when(F.col("ending").isNotNull(), at)), F.lit("running")).alias("state"),
        )
