"""Session rules in event time: rows wait in list state until the watermark passes them, then a rule takes them in order.

The rules are those of ``functions.steps``. Arrival order does not matter, within a micro-batch
or across them, as long as a row comes before the micro-batch that takes its time; Spark drops
a row that is behind the watermark of the micro-batch before its own (``spend.RunningSpend``
shows how to keep such rows). Rows without a time are dropped, and so are those of before 1970,
where a watermark begins. Rows that the watermark has not reached wait, also when a stream ends.

What a rule carries on is a value state of typed columns, which holds one message, one
utterance, four numbers or the last chunks of the replay log. A key has one timer, at its
earliest waiting row; no more rows wait than come within the watermark's delay, and those that
fall due in one micro-batch are sorted in memory. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxframe.functions import steps
from voxframe.streaming.keyed import APPENDED, _out, _run, append, entries, packed, plain

#: When a row happened, in microseconds since 1970.
TIME = "event_time_us"


class _InOrder(StatefulProcessor):
    """Waiting rows of a key, handed to ``take`` in order of time and of the order columns, with what it carried.

    ``held`` is the key's timer and what it carries. Each call to a state is a message to the
    executor and back, so a key makes only a few in a micro-batch.
    """

    def __init__(self, columns: list[str], kept: T.StructType, order: list[str], carried: str):
        self.row, self.names, self.carried = Row(*columns), kept.names, carried
        self.kept, self.time = kept, kept.names.index(TIME)
        self.order = [kept.names.index(c) for c in (TIME, *order)]
        self.carries = T._parse_datatype_string(carried).names
        numbers = (T.DoubleType, T.IntegralType)
        self.missing = {f.name: math.nan for f in kept.fields if isinstance(f.dataType, (T.DoubleType, T.IntegralType)) and f.name not in order}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.kept.fields]))
        self.held = handle.getValueState("held", f"timer_at long, begun boolean, {self.carried}")

    def take(self, key: tuple, state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        """Output rows and what is carried on."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, some, first = None, [], None
        for row in rows:
            if at is None:
                at = [row.__fields__.index(c) for c in self.names]
            some.append(tuple(row[i] for i in at))
            first = some[-1][self.time] if first is None else min(first, some[-1][self.time])
            if len(some) == APPENDED:
                append(self.waiting, some)
                some = []
        if some:
            append(self.waiting, some)
        if first is not None:
            due = -(-first // 1000)
            known, *held = self.held.get() or (None, False, *[None] * len(self.carries))
            if known is None or due < known:
                if known is not None:
                    self.handle.deleteTimer(known)
                self.handle.registerTimer(due)
                self.held.update((due, *held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, key = timerValues.getCurrentWatermarkInMs() * 1000, plain(key)
        due, rest = [], []
        for row in entries(self.waiting):
            (due if row[self.time] <= now else rest).append(row)
        _, begun, *carried = self.held.get()
        timer = -(-min(row[self.time] for row in rest) // 1000) if rest else None
        if rest:
            self.handle.registerTimer(timer)
        if not due:
            self.held.update((timer, begun, *carried))
            return iter(())
        if rest:
            self.waiting.put([packed(rest)])
        else:
            self.waiting.clear()
        due.sort(key=lambda row: [(row[i] is None, row[i]) for i in self.order])
        known = dict(zip(self.keys, key))
        rows = [known | {n: self.missing.get(n) if v is None else v for n, v in zip(self.names, row)} for row in due]
        out, after = self.take(key, dict(zip(self.carries, carried)) if begun else None, rows)
        self.held.update((timer, True, *[after[n] for n in self.carries]))
        # a missing number is a null again
        return iter([self.row(*[None if v != v else v for v in values]) for values in out])

    def close(self) -> None:
        pass


class _Rule(_InOrder):
    """A step whose state is kept as typed columns."""

    def __init__(self, columns, kept, order, keys, step, carried: str):
        super().__init__(columns, kept, order, carried)
        self.keys, self.step = keys, step

    def take(self, key: tuple, state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        return self.step.fold(state, rows)


class _Replay(_InOrder):
    """The last chunks, carried as two arrays of up to ``capacity`` entries."""

    def __init__(self, columns, kept, order, keys, capacity: int):
        super().__init__(columns, kept, order, "idxs array<long>, texts array<string>")
        self.keys, self.capacity = keys, capacity

    def take(self, key: tuple, state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        log, out = deque(zip(state["idxs"], state["texts"]) if state else (), self.capacity), []
        for row in rows:
            if row["type"] == "chunk":
                log.append((int(row["idx"]), row["text"]))
            else:
                out += [[*key, row["at"], i, t] for i, t in log if i > row["idx"]]
        return out, {"idxs": [i for i, _ in log], "texts": [t for _, t in log]}


def _timed(df: DataFrame, keys: Sequence[str], ts: str, needed: dict[str, str]) -> tuple[DataFrame, T.StructType]:
    """Rows with a time, and what of them waits."""
    rows = df.where(F.col(ts).isNotNull()).select(*keys, ts, *[F.col(c).cast(kind).alias(c) for c, kind in needed.items()], F.unix_micros(ts).alias(TIME))
    return rows, T.StructType([*(f for f in rows.schema.fields if f.name in needed), rows.schema[TIME]])


def _ruled(df: DataFrame, keys: Sequence[str], ts: str, order: list[str], needed: dict[str, str], step, carried: str, more: str, row_id: str | None = None) -> DataFrame:
    rows, kept = _timed(df, keys, ts, needed)
    out = _out(rows, [*keys, *([row_id] if row_id else [])], more)
    return _run(rows, keys, _Rule(out.names, kept, order, list(keys), step, carried), out, "EventTime")


def sentence_chunks(events: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts") -> DataFrame:
    """Deltas to sentence chunks: rows carry row_id, type, text and enabled; ties in time go by row_id."""
    needed = {row_id: "bigint", "type": "string", "text": "string", "enabled": "boolean"}
    carried = "buffer string, ticks long, block boolean, inline boolean, n long, `on` boolean"
    return _ruled(events, keys, ts, [row_id], needed, steps.sentence_chunker(list(keys), row_id), carried, "chunk_idx bigint, chunk string", row_id)


def utterances(frames: DataFrame, keys: Sequence[str], ts: str = "ts", **limits) -> DataFrame:
    """Frames to utterances: rows carry frame_idx, value and flush."""
    needed = {"frame_idx": "bigint", "value": "double", "flush": "boolean"}
    carried = "start long, length long, speech long, silence long"
    return _ruled(frames, keys, ts, ["frame_idx"], needed, steps.utterances(list(keys), **limits), carried, "start_idx bigint, n_frames bigint, speech_frames bigint")


def emotion_states(readings: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts") -> DataFrame:
    """Decaying emotion: rows carry row_id, ts_ms, emotion and confidence."""
    needed = {row_id: "bigint", "ts_ms": "double", "emotion": "string", "confidence": "double"}
    more = "state_emotion string, state_intensity double, half_life_ms double, current_intensity double"
    return _ruled(readings, keys, ts, [row_id], needed, steps.emotion_state(list(keys), row_id), "emotion string, intensity double, `at` double, half double", more, row_id)


def filler_plan(trips: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts") -> DataFrame:
    """Predicted round trip and filler: rows carry row_id, rtt_ms and audio_bytes."""
    needed = {row_id: "bigint", "rtt_ms": "double", "audio_bytes": "bigint"}
    more = "ema double, gap_ms double, total_filler_ms double"
    return _ruled(trips, keys, ts, [row_id], needed, steps.filler(list(keys), row_id), "ema double, n long, budget double, total double", more, row_id)


def replayed(marks: DataFrame, keys: Sequence[str], ts: str = "ts", capacity: int = 20) -> DataFrame:
    """Answers to a resume: rows carry type (chunk, resume), idx, text and at; ties in time go by at."""
    rows, kept = _timed(marks, keys, ts, {"at": "bigint", "type": "string", "idx": "bigint", "text": "string"})
    out = _out(rows, keys, "resume_at bigint, idx bigint, text string")
    return _run(rows, keys, _Replay(out.names, kept, ["at"], list(keys), capacity), out, "EventTime")
