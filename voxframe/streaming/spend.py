"""Running spend and latency with a second output: rows that come too late go to a table of their own."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.session import shared_dir

_SUMS = "day date, calls bigint, hits bigint, audio_sec double, cost_usd double, rtt_ms double, min_rtt_ms double, max_rtt_ms double, batch bigint"


class RunningSpend:
    """A folder with the day sums of each micro-batch, the late rows and how far time has come.

    Each batch writes under its own number, so a batch that is run again replaces itself and
    nothing is counted twice. The mark below which a row is late follows from the batches
    before it: the latest time seen, less the allowed delay.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, delay: str, folder: str | None = None):
        self.spark, self.schema, self.delay = spark, schema, delay
        self.folder = folder or f"{shared_dir(spark)}/spend-{uuid.uuid4().hex}"

    def _known(self, name: str, schema: T.StructType | str, batch: int | None = None) -> DataFrame:
        """Rows of a table, those of batches before `batch` alone if one is given."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        numbers = [int(x.getPath().getName().split("=")[1]) for x in files.listStatus(root)] if files.exists(root) else []
        paths = [f"{self.folder}/{name}/batch={n}" for n in sorted(numbers) if batch is None or n < batch]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of ``(ts, audio_duration_sec, cache_hit, cost_usd, rtt_ms, ...)``."""
        seen = self._known("seen", "latest timestamp", batch).agg(F.max("latest")).first()[0]
        mark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        late = F.coalesce(F.col("ts") < mark, F.lit(False))
        rows = rows.persist()
        rows.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch}")
        rtt = F.col("rtt_ms")
        sums = rows.where(~late).groupBy(F.to_date("ts").alias("day")).agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if("cache_hit").alias("hits"),
            F.sum("audio_duration_sec").alias("audio_sec"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum(rtt).alias("rtt_ms"),
            F.min(rtt).alias("min_rtt_ms"),
            F.max(rtt).alias("max_rtt_ms"),
        )
        sums.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch}")
        rows.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{self.folder}/seen/batch={batch}")
        rows.unpersist()

    def run(self, stream: DataFrame) -> RunningSpend:
        """Take what a stream has now."""
        sink: Callable[[DataFrame, int], None] = self.write
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def late_rows(self) -> DataFrame:
        return self._known("late", self.schema)

    def history(self) -> DataFrame:
        """Day sums of each micro-batch."""
        return self._known("sums", _SUMS)

    def totals(self, *keys: str) -> DataFrame:
        """Spend and latency so far, of all or by ``day``."""
        calls = F.sum("calls")
        return self.history().groupBy(*keys).agg(
            F.coalesce(calls, F.lit(0)).alias("calls"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
            F.try_divide(F.sum("hits") * 100.0, calls).alias("hit_pct"),
            F.coalesce(F.sum("audio_sec"), F.lit(0.0)).alias("audio_sec"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
            F.coalesce(F.try_divide(F.sum("rtt_ms"), calls), F.lit(0.0)).alias("mean_rtt_ms"),
            F.coalesce(F.min("min_rtt_ms"), F.lit(0.0)).alias("min_rtt_ms"),
            F.coalesce(F.max("max_rtt_ms"), F.lit(0.0)).alias("max_rtt_ms"),
        )
