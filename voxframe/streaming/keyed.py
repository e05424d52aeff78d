"""Keyed streams on map, list and value state: what is done with leaves the state.

Rows of a micro-batch come in whatever order; the rules are stated so that the order within a
batch does not matter. Every call to a state is a message to the executor and back, so a key
makes a few of them in a micro-batch: what waits is written as one list, read as one, and has
one timer.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from voxframe.streaming.stateful import ROCKSDB


def _filler(kind: T.DataType) -> Column:
    return F.lit("" if isinstance(kind, T.StringType) else "1970-01-01" if isinstance(kind, T.DateType) else 0).cast(kind)


def plain(key: tuple) -> tuple:
    """The key without its marks."""
    size = len(key) // 2
    return tuple(None if missing else value for value, missing in zip(key[:size], key[size:]))


def _run(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, output: T.StructType, mode: str) -> DataFrame:
    # map and list state exist in this store alone
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # a null key does not come back from the state as it went in, so it is a filler and a mark beside it
    marks = {f"_no_{k}": F.col(k).isNull() for k in keys}
    df = df.withColumns(marks).withColumns({k: F.coalesce(F.col(k), _filler(df.schema[k].dataType)) for k in keys})
    return df.groupBy(*keys, *marks).transformWithState(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode=mode)


def _out(df: DataFrame, keys: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(more).fields])


#: Rows of a key that are written to its state at once.
APPENDED = 10_000


def packed(rows: list[tuple]) -> tuple:
    """Rows as one entry of a list state: an array for each column, which is coded and sent at a fraction of the cost of entries."""
    return tuple(list(column) for column in zip(*rows))


def append(state: ListState, rows: list[tuple]) -> None:
    state.appendValue(packed(rows))


def entries(state: ListState) -> Iterator[tuple]:
    """The rows of all entries."""
    return (row for entry in state.get() for row in zip(*entry))


class _Delivery(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.row = Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "idx long", "payload string, arrived long")
        self.cursor = handle.getValueState("cursor", "next long, latest long, received long, total long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        key = plain(key)
        following, latest, received, total = self.cursor.get() or (0, -1, 0, None)
        fresh, closing = {}, None
        for row in rows:
            if row["total"] is not None:
                closing = row["total"] if closing is None else max(closing, row["total"])
            if row["idx"] is not None:
                received += 1
                if row["idx"] >= following:
                    value = (row["payload"], row["arrived"])
                    fresh[row["idx"]] = (fresh.get(row["idx"], (value,))[0], value)
        total = total if closing is None else closing
        if following in fresh:
            waiting = {idx: value for (idx,), value in self.held.iterator()}
            while following in fresh or following in waiting:
                # a chunk that came again does not change one that is given out, but replaces one that waits
                given, _ = fresh.pop(following, (None, None))
                if following in waiting:
                    given = waiting[following]
                    self.held.removeKey((following,))
                payload, arrived = given
                latest = max(latest, arrived)
                yield self.row(*key, "chunk", following, payload, latest, None, None)
                following += 1
        for idx, (_, value) in fresh.items():
            self.held.updateValue((idx,), value)
        self.cursor.update((following, latest, received, total))
        status = "filling" if total is None else "done" if following >= total else "draining"
        yield self.row(*key, status, following, None, None, received, total)

    def close(self) -> None:
        pass


def delivery(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks in order, and where each key stands.

    Rows are ``(keys, idx, payload, arrived, total)``: a chunk, or with a null ``idx`` the word
    that the key has ``total`` chunks. Output rows of kind ``chunk`` have idx, payload and
    ``released_by``, the latest arrival among chunks 0..idx. Each micro-batch adds a row of kind
    ``filling`` (total unknown), ``draining`` or ``done``, with the chunks given out so far in
    ``idx``, and received and total. A chunk that waits is one map entry until it is given out;
    a chunk that has been given out is not given out again.
    """
    out = _out(results, keys, "kind string, idx long, payload string, released_by long, received long, total long")
    return _run(results, keys, _Delivery(out.names), out, "None")


RESET, REQUEST, RESULT = 0, 1, 2
MARKS = {"reset": RESET, "request": REQUEST, "result": RESULT}


class _Fence(StatefulProcessor):
    def __init__(self, columns: list[str], patience_ms: float):
        self.row, self.patience_ms = Row(*columns), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "kinds array<int>, requests array<long>, ats array<double>")
        self.past = handle.getValueState("past", "resets long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, some = math.inf, []
        for row in rows:
            kind, at = MARKS[row["type"]], row["at"]
            some.append((kind, row["request"], at))
            if kind != RESET:
                due = min(due, at if kind == RESULT else at + self.patience_ms)
            if len(some) == APPENDED:
                append(self.waiting, some)
                some = []
        if some:
            append(self.waiting, some)
        if due < math.inf:
            past, timer = self.past.get() or (0, None)
            if timer is None or math.ceil(due) < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(math.ceil(due))
                self.past.update((past, math.ceil(due)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, key = timerValues.getCurrentWatermarkInMs(), plain(key)
        before, _ = self.past.get()
        resets, marks = [], {}
        for kind, request, at in entries(self.waiting):
            if kind == RESET:
                resets.append(at)
            else:
                marks.setdefault(request, {})[kind] = at
        resets.sort()
        out, rest, timer, settled = [], [], None, now
        for request, at in marks.items():
            asked, finished = at.get(REQUEST), at.get(RESULT)
            if finished is not None and asked is not None and finished <= now:
                # every reset up to the result is known
                earlier = bisect_right(resets, asked)
                if bisect_right(resets, finished) <= earlier:
                    out.append(self.row(*key, request, before + earlier))
                continue
            last = (finished if asked is None else asked) + self.patience_ms
            if last < now:
                continue
            if asked is not None:
                settled = min(settled, asked)
                if finished is not None:
                    last = min(last, finished)
            rest += [(kind, request, x) for kind, x in at.items()]
            # a row is given up only after its patience
            last = max(math.ceil(last), now + 1)
            timer = last if timer is None else min(timer, last)
        # resets that every open and every later request comes after are only counted
        counted = bisect_right(resets, settled)
        rest += [(RESET, None, x) for x in resets[counted:]]
        if rest:
            self.waiting.put([packed(rest)])
        else:
            self.waiting.clear()
        if timer is not None:
            self.handle.registerTimer(timer)
        self.past.update((before + counted, timer))
        return iter(out)

    def close(self) -> None:
        pass


def fence(marks: DataFrame, keys: Sequence[str], patience_ms: float) -> DataFrame:
    """Results whose key was not reset between request and result: keys, request, generation.

    Rows are ``(keys, type, request, at, ts)``, type one of reset, request and result, ``at``
    in milliseconds and ``ts`` the same as a timestamp under a watermark. A result is decided
    when the watermark passes it, so rows may come in any order that the watermark allows. A
    request without a result is forgotten ``patience_ms`` after it, and resets that no open
    request can meet are kept as a number alone. Rows without a time are dropped.
    """
    marks = marks.where(F.col("at").isNotNull() & F.col("ts").isNotNull())
    out = _out(marks, keys, "request long, generation long")
    return _run(marks, keys, _Fence(out.names, float(patience_ms)), out, "EventTime")
