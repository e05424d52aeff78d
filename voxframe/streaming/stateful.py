"""Keyed stateful streams and the plumbing to run them to completion."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxframe.functions import steps
from voxframe.operators import sessions
from voxframe.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StepProcessor(StatefulProcessor):
    """Keeps one JSON state per key and folds each micro-batch through a step."""

    def __init__(self, step, order: Sequence[str], columns: Sequence[str]):
        self.step, self.order, self.columns = step, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the shuffle loses arrival order, so the key's rows of this micro-batch
        # are put in order first; the trigger bounds how many there are
        batch = pd.concat(rows).sort_values(self.order, kind="stable").reset_index(drop=True)
        before = self.state.get()[0] if self.state.exists() else None
        out, after = self.step(before, batch)
        self.state.update((after,))
        yield out[self.columns].reset_index(drop=True)

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step, output: T.StructType) -> DataFrame:
    """Fold every key of a stream through a step; the batch twins are in ``operators.recursions``."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    processor = StepProcessor(step, order, [f.name for f in output.fields])
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="None"
    )


def _fields(df: DataFrame, columns: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *T._parse_datatype_string(more).fields])


def sentence_chunks(events: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    out = _fields(events, [*keys, row_id], "chunk_idx bigint, chunk string")
    return stream_fold(events, keys, order, steps.sentence_chunker(list(keys), row_id), out)


def utterances(frames: DataFrame, keys: Sequence[str], **limits) -> DataFrame:
    out = _fields(frames, keys, "start_idx bigint, n_frames bigint, speech_frames bigint")
    return stream_fold(frames, keys, ["frame_idx"], steps.utterances(list(keys), **limits), out)


def emotion_states(readings: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    out = _fields(
        readings, [*keys, row_id], "state_emotion string, state_intensity double, half_life_ms double, current_intensity double"
    )
    return stream_fold(readings, keys, ["ts_ms", row_id], steps.emotion_state(list(keys), row_id), out)


def filler_plan(trips: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    out = _fields(trips, [*keys, row_id], "ema double, gap_ms double, total_filler_ms double")
    return stream_fold(trips, keys, order, steps.filler(list(keys), row_id), out)


def reassembled(results: DataFrame, keys: Sequence[str], arrived: str = "arrived") -> DataFrame:
    out = _fields(results, keys, "idx bigint, payload string, released_by bigint")
    return stream_fold(results, keys, [arrived, "idx"], steps.reassemble(list(keys)), out)


def fenced_results(marks: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    out = _fields(marks, [*keys, row_id], "generation bigint")
    return stream_fold(marks, keys, order, steps.generation_fence(list(keys), row_id), out)


def replayed(marks: DataFrame, keys: Sequence[str], order: Sequence[str], capacity: int = 20) -> DataFrame:
    out = _fields(marks, keys, "resume_at bigint, idx bigint, text string")
    return stream_fold(marks, keys, order, steps.recent_log(list(keys), capacity), out)


def daily_totals(receipts: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Spend per day over a stream; rows later than the watermark are dropped from the totals.

    ``spend.RunningSpend`` keeps them in a table of their own."""
    day = F.window(ts, "1 day")
    totals = sessions.ledger_totals(receipts.withWatermark(ts, late), [day.alias("day")])
    return totals.select(F.to_date(F.col("day.start")).alias("day"), *[c for c in totals.columns if c != "day"])


def job_status(lines: DataFrame, keys: Sequence[str], order: str, line: str = "value") -> DataFrame:
    """Latest progress of followed jobs, for update or complete mode."""
    from voxframe.operators.text import job_status as batch

    return batch(lines, keys, order, line)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote.

    Output goes to the shared folder, not through the driver.  Complete and
    update modes replace the table with the newest state per batch.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/out")
    else:
        query = writer.foreachBatch(_replace(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def staged(df: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """Write a derived table to the shared folder and read it back as a stream."""
    folder = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return read_stream(df.sparkSession, folder, df.schema, files_per_trigger=files_per_trigger)


def waves(df: DataFrame, wave: str, count: int, files: int = 4) -> str:
    """Write a table to the shared folder wave by wave, each in ``files`` files, so that a stream meets them in turn.

    The table is computed once, whatever the number of waves.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    folder, parts = (f"{shared_dir(spark)}/{kind}-{name}" for kind in ("waves", "wave-parts"))
    df.write.partitionBy(wave).parquet(parts)
    rows = spark.read.schema(df.schema).parquet(parts).select(df.columns)
    for k in range(count):
        rows.where(F.col(wave) == k).drop(wave).repartition(files).write.mode("append").parquet(folder)
    return folder


def _replace(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch writes the same state again
        batch.write.mode("overwrite").parquet(path)

    return write


def idempotent_append(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: one folder per batch id, so a retry replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int = 100
) -> DataFrame:
    """A file stream with a fixed schema and a bounded micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
