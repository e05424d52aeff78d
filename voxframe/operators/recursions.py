"""Order-dependent recursions without a chain of driver rounds.

Each recursion has a way of its own to cut a series of any length:

* **Pieces** (decaying emotion, utterances): the series is cut where what came before is
  certain to have no more weight, so pieces run side by side.
* **Summaries that compose** (emotion, cool-down, sentence chunks): a block of rows becomes a
  small map from what may enter it to what leaves it. Only these maps, one a block, are gone
  through in order per series; then every block runs once with its true entry.
* **Rounds of whole decisions** (distinct regions): see ``distinct_regions``.

Rows are streamed through sorted partitions and never gathered per series; a task holds an
Arrow batch and the state of one series.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxframe.functions import chunking
from voxframe.functions import textrules as tr
from voxframe.functions.steps import decayed
from voxframe.operators.ordered import _attach, fill_forward
from voxframe.session import shared_dir

Row = tuple
Fold = Callable[[Any, Row], tuple[Any, list[Row]]]


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write to a table of its own in the shared folder and read it again, so a lost executor repeats no more than this step."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_groups(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Any],
    step: Callable[[Any, Row], list[Row]],
    end: Callable[[Any], list[Row]],
    output: T.StructType,
) -> DataFrame:
    """Fold the ordered rows of every group, streamed from sorted partitions.

    ``start()`` makes a mutable state, ``step(state, row)`` takes the row's columns that are
    not of the group and gives output rows, ``end(state)`` the rows after the last one. The
    columns of the group are put in front of each output row.
    """
    by, rest = list(group), [c for c in df.columns if c not in group]
    schema = to_arrow_schema(output)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            keys = zip(*(columns[c] for c in by), strict=True)
            rows = zip(*(columns[c] for c in rest), strict=True)
            for own, row in zip(keys, rows, strict=True):
                if own != key or state is None:
                    if state is not None:
                        out += [(*key, *x) for x in end(state)]
                    key, state = own, start()
                out += [(*key, *x) for x in step(state, row)]
                if len(out) >= 20_000:
                    yield flush()
        if state is not None:
            out += [(*key, *x) for x in end(state)]
        yield flush()

    # a stated count keeps AQE from merging small but slow Python partitions
    return df.select(*by, *rest).repartition(parts, *by).sortWithinPartitions(*by, *order).mapInArrow(run, output)


def _fields(df: DataFrame, columns: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *(T._parse_datatype_string(more).fields if more else [])])


def _one_block(df: DataFrame, block: str) -> bool:
    """Whether all rows are of one block, so that nothing is carried between blocks."""
    return df.select(block).distinct().limit(2).count() < 2


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, value: str, marked: Column, limit: float, name: str = "home") -> DataFrame:
    """Add the block in which the row's piece begins.

    A piece begins at a marked row whose ``value`` lies more than ``limit`` above that of the
    marked row before it, or that has none before it. Rows ahead of a series' first piece have
    a null home.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(marked, F.col(value))
    local = df.withColumn("_near", F.max(seen).over(inside))
    carry = df.groupBy(*keys, block).agg(F.max(seen).alias("_last")).select(*keys, block, F.max("_last").over(before).alias("_far"))
    last = F.coalesce("_near", "_far")
    cut = marked & (last.isNull() | (F.col(value) - last > limit))
    rows = _attach(local, carry, [*keys, block]).withColumn("_cut", F.when(cut, F.col(block))).drop("_near", "_far")
    return fill_forward(rows, keys, order, block, {name: F.col("_cut")}).drop("_cut")


# ---- decaying emotion


def _react(s: list, now: float, mood: str, sure: float) -> float:
    """Change the state [emotion, intensity, at, half_life] by a reading; the level right after it."""
    level = 0.0 if s[0] == "neutral" else decayed(s[1], now - s[2], s[3])
    if mood == "neutral" or sure == 0.0:
        s[3] = min(s[3], tr.FAST_HALF_LIFE_MS)
    elif mood == s[0] or sure >= level:
        s[1] = min(1.0, level + sure * tr.SAME_EMOTION_GAIN) if mood == s[0] else sure
        s[0], s[2], s[3] = mood, now, tr.HALF_LIFE_MS
    else:
        s[1], s[3] = level * tr.OVERRULED_FACTOR, tr.FAST_HALF_LIFE_MS
    return 0.0 if s[0] == "neutral" else decayed(s[1], now - s[2], s[3])


class _Reactions:
    """What a stretch does to a state that has faded: one outcome if its emotion is the first one read, one if not."""

    def __init__(self) -> None:
        self.first: str | None = None
        self.same: list | None = None
        self.other: list | None = None
        self.calm = False

    def add(self, now: float, mood: str, sure: float) -> None:
        if not 0.0 <= sure <= 1.0:
            raise ValueError(f"a confidence of {sure} is not in 0..1")
        if self.first is None:
            if mood == "neutral" or sure == 0.0:
                self.calm = True
                return
            self.first = mood
            self.same, self.other = [mood, 0.0, -math.inf, tr.HALF_LIFE_MS], ["neutral", 0.0, -math.inf, tr.HALF_LIFE_MS]
        _react(self.same, now, mood, sure)
        if self.other is not None:
            _react(self.other, now, mood, sure)
            if self.other == self.same:
                self.other = None  # from here on the entry has no weight

    def row(self) -> Row:
        same, other = self.same or [None] * 4, self.other or self.same or [None] * 4
        return (self.first, same[0], same[1], same[3], other[0], other[1], other[3], self.calm)


_REACTIONS = (
    "first string, same_emotion string, same_intensity double, same_half double, other_emotion string, other_intensity double, other_half double, calm boolean"
)


def _pass_on(state: list, row: Row) -> list[Row]:
    """Entry of each block: the state, emotion, intensity and half-life, that the blocks before it leave."""
    home, first, same_e, same_i, same_h, other_e, other_i, other_h, calm = row
    out = [(home, *state)] if state[0] is not None else []
    known = ["neutral", 0.0, tr.HALF_LIFE_MS] if state[0] is None else list(state)
    if first is None:
        known[2] = min(known[2], tr.FAST_HALF_LIFE_MS) if calm else known[2]
    elif known[0] == first:
        known = [same_e, same_i, same_h]
    else:
        known = [other_e, other_i, other_h]
    state[:] = known
    return out


def emotion_states(readings: DataFrame, keys: Sequence[str], row_id: str, block: str = "block") -> DataFrame:
    """State after every reading ``(keys, row_id, ts_ms, emotion, confidence)``.

    After a gap in which an intensity of one decays under the floor, the level is certain to be
    nothing: all that such a piece can learn of the past is which emotion it was (and, while
    only neutral readings follow, its faded numbers). A block that begins with a piece is so
    summed up by two outcomes, and two such maps in a row are one again. Blocks without such a
    gap belong to the block before them; a series without any gap is one piece, which streams
    through one task.
    """
    gap = tr.HALF_LIFE_MS * math.log2(1.0 / tr.INTENSITY_FLOOR)
    used = kept(readings.select(*keys, block, row_id, F.col("ts_ms").cast("double").alias("ts_ms"), "emotion", F.col("confidence").cast("double").alias("confidence")), "readings")
    columns = [*keys, "home", "ts_ms", row_id, "emotion", "confidence"]
    if _one_block(used, block):
        rows = used.withColumnRenamed(block, "home").select(columns)
    else:
        rows = kept(pieces(used, keys, ["ts_ms", row_id], block, "ts_ms", F.lit(True), gap).select(columns), "pieces")
    group = [*keys, "home"]

    def begin() -> list:
        return ["neutral", 0.0, -math.inf, tr.HALF_LIFE_MS]

    def step(s: list, row: Row) -> list[Row]:
        source, now, own, mood, sure = row
        if source == 0:
            s[0], s[1], s[3] = mood, sure, now
            return []
        if not 0.0 <= sure <= 1.0:
            raise ValueError(f"a confidence of {sure} is not in 0..1")
        level = _react(s, now, mood, sure)
        return [(own, s[0], s[1], s[3], level)]

    own = rows.select(*keys, "home", F.lit(1).alias("_src"), "ts_ms", row_id, "emotion", "confidence")
    out = _fields(rows, group, "").add(rows.schema[row_id])
    for name, kind in (("state_emotion", "string"), ("state_intensity", "double"), ("half_life_ms", "double"), ("current_intensity", "double")):
        out = out.add(name, kind)

    # maps are needed of blocks that another of their series follows
    last = rows.groupBy(*keys).agg(F.min("home").alias("_first"), F.max("home").alias("_last"))
    if last.where("_first < _last").isEmpty():
        return in_groups(own, group, ["_src", "ts_ms", row_id], begin, step, lambda s: [], out).drop("home")
    last = last.drop("_first")
    followed = _attach(rows, last, keys).where(~F.col("home").eqNullSafe(F.col("_last"))).drop("_last")
    maps = in_groups(
        followed, group, ["ts_ms", row_id], _Reactions, lambda s, r: s.add(r[0], r[2], r[3]) or [], lambda s: [s.row()], _fields(rows, group, _REACTIONS)
    )
    nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in T._parse_datatype_string(_REACTIONS).fields)
    ends = last.selectExpr(*keys, "_last AS home", *nothing.split(", "))
    entries = in_groups(
        maps.unionByName(ends), keys, ["home"], lambda: [None, None, None], _pass_on, lambda s: [], _fields(rows, group, "emotion string, intensity double, half double")
    )

    entered = entries.select(*keys, "home", F.lit(0).alias("_src"), F.col("half").alias("ts_ms"), F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), "emotion", F.col("intensity").alias("confidence"))
    return in_groups(own.unionByName(entered), group, ["_src", "ts_ms", row_id], begin, step, lambda s: [], out).drop("home")


# ---- cool-down

#: The block of rows without a time.
_LAST = 2**62


def cool_down(events: DataFrame, keys: Sequence[str], row_id: str, cooldown_ms: float, block: str = "block") -> DataFrame:
    """Keep a row only if the last kept one is at least ``cooldown_ms`` back; of equal times the first by ``row_id``.

    Each row points to the next one that would be kept after it. Within a block the way along
    these pointers is followed backwards once, so a block becomes a rising step function from
    the last time kept before it to the last time kept in it. Ways that begin at different
    rows soon run together, so it has few steps. Blocks hand the last kept time on through
    these functions, then every block marks its own rows. Rows without a time come last: the
    first of them is kept if its key has no other rows.
    """
    timed = F.col("ts_ms").isNotNull() & ~F.isnan(F.col("ts_ms").cast("double"))
    used = events.select(*keys, F.when(timed, F.col(block)).otherwise(F.lit(_LAST)).alias(block), row_id, "ts_ms")
    if cooldown_ms <= 0:
        return events.select(*keys, row_id, "ts_ms")
    used = kept(used, "events")
    group = [*keys, block]

    def mark(s: list, row: Row) -> list[Row]:
        source, at, now, own, entry = row
        if source == 0:
            s[0] = entry
        elif s[0] is None or (at != _LAST and now >= s[0] + cooldown_ms):
            s[0] = math.inf if at == _LAST else now
            return [(own, now)]
        return []

    def marked(rows: DataFrame) -> DataFrame:
        stretch = rows.withColumn("_at", F.col(block))
        fields = _fields(used, [*group, row_id, "ts_ms"], "")
        return in_groups(stretch.select(*group, "_src", "_at", "ts_ms", row_id, "entry"), group, ["_src", "ts_ms", row_id], lambda: [None], mark, lambda s: [], fields).drop(block)

    own = used.select("*", F.lit(1).alias("_src"), F.lit(None).cast("double").alias("entry"))
    last = used.groupBy(*keys).agg(F.min(block).alias("_first"), F.max(block).alias("_last"))
    if last.where("_first < _last").isEmpty():
        return marked(own)

    def summed(times: list[float]) -> list[Row]:
        # in order; a first row kept at or before `upto` leads to `leaves`
        n, following = len(times), len(times)
        leaves = times.copy()
        for i in range(n - 1, -1, -1):
            while following and times[following - 1] >= times[i] + cooldown_ms:
                following -= 1
            if following < n:
                leaves[i] = leaves[following]
        ends = [i for i in range(n) if i == n - 1 or leaves[i + 1] != leaves[i]]
        return [([times[i] for i in ends], [leaves[i] for i in ends])]

    def gather(times: list[float], row: Row) -> list[Row]:
        if not times or row[0] != times[-1]:
            times.append(row[0])
        return []

    def pass_on(state: list, row: Row) -> list[Row]:
        at, upto, leaves = row
        entry = state[0]
        if upto:
            i = 0 if entry is None else bisect.bisect_left(upto, entry + cooldown_ms)
            if i < len(upto):
                state[0] = leaves[i]
        return [(at, entry)]

    # steps are needed of blocks that another of their series follows
    followed = _attach(used.select(*group, F.col("ts_ms").cast("double").alias("ts_ms")), last.drop("_first"), keys).where(F.col(block) < F.col("_last")).drop("_last")
    steps = in_groups(followed, group, ["ts_ms"], list, gather, summed, _fields(used, group, "upto array<double>, leaves array<double>"))
    ends = last.select(*keys, F.col("_last").alias(block), F.lit(None).cast("array<double>").alias("upto"), F.lit(None).cast("array<double>").alias("leaves"))
    entries = in_groups(steps.unionByName(ends), keys, [block], lambda: [None], pass_on, lambda s: [], _fields(used, group, "entry double"))
    kinds = {f.name: f.dataType for f in used.schema.fields}
    entered = entries.select(*group, *[F.lit(None).cast(kinds[c]).alias(c) for c in (row_id, "ts_ms")], F.lit(0).alias("_src"), "entry")
    return marked(own.unionByName(entered))


# ---- utterances


def utterance_segments(
    frames: DataFrame, keys: Sequence[str], block: str = "block", threshold: float = 0.03, min_silence: int = 13, min_speech: int = 16, max_speech: int = 500
) -> DataFrame:
    """Utterances of frame series; the last frame of a series flushes.

    An utterance closes after ``min_silence`` silent frames (then trimmed), or is cut at
    ``max_speech`` speech frames; shorter ones are dropped. After ``min_silence`` silent frames
    none is open, so the next loud frame begins a piece that nothing before it can change.
    """
    last = frames.groupBy(*keys).agg(F.max("frame_idx").alias("_last"))
    used = _attach(frames.select(*keys, block, "frame_idx", "value"), last, keys)
    used = kept(used.select(*keys, block, "frame_idx", (F.col("value") > threshold).alias("loud"), (F.col("frame_idx") == F.col("_last")).alias("flush")), "loudness")
    loud = F.coalesce("loud", F.lit(False))
    cut = pieces(used.withColumn("loud", loud), keys, ["frame_idx"], block, "frame_idx", F.col("loud"), min_silence)

    def step(s: dict, row: Row) -> list[Row]:
        at, loud, flush = row
        out, open_ = [], s.get("start") is not None
        if loud or open_:
            if not open_:
                s.update(start=at, length=0, speech=0, silence=0)
            s["length"] += 1
            s["speech"] += loud
            s["silence"] = 0 if loud else s["silence"] + 1
            if s["silence"] >= min_silence:
                if s["speech"] >= min_speech:
                    out.append((s["start"], s["length"] - s["silence"], s["speech"]))
                s["start"] = None
            elif s["speech"] >= max_speech:
                out.append((s["start"], s["length"], s["speech"]))
                s["start"] = None
        if flush and s.get("start") is not None:
            if s["speech"] >= min_speech:
                out.append((s["start"], s["length"], s["speech"]))
            s["start"] = None
        return out

    rows = cut.where(F.col("home").isNotNull()).select(*keys, "home", "frame_idx", "loud", "flush")
    group = [*keys, "home"]
    found = in_groups(rows, group, ["frame_idx"], dict, step, lambda s: [], _fields(rows, group, "start_idx bigint, n_frames bigint, speech_frames bigint"))
    return found.drop("home")


# ---- sentence chunks of delta sessions


def session_chunks(events: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str, block: str = "block") -> DataFrame:
    """Sentence chunks of delta sessions ``(type, text, enabled)``: keys, row_id, chunk_idx, chunk.

    Text is buffered while the switch is off; switching off clears, switching on cuts what has
    gathered; a message end flushes (on) or discards (off), a reset clears. So a session falls
    into units that share nothing but the switch, which is filled forward. A unit gives all its
    chunks if the switch is on at its end, and what is left of it only at a message end.

    A unit may lie over any number of blocks. Code marks make each block's part a map from
    sixteen states of being inside or outside of code; these are passed on in order. With its
    true state known, each part is cut by itself into a head, whole chunks and a tail. Tails
    and heads that meet are joined and cut again (``chunking``). ``row_id`` is that of the
    event with which a chunk comes free.
    """
    used = kept(events.select(*keys, block, *dict.fromkeys([*order, row_id]), "type", "text", "enabled"), "deltas")
    sort = list(dict.fromkeys([*order, row_id]))
    switch = F.when(F.col("type") == "set_config", F.coalesce("enabled", F.lit(False)))
    state = fill_forward(used, keys, sort, block, {"on": switch})
    on = F.coalesce("on", F.lit(True))
    inside = Window.partitionBy(*keys, block).orderBy(*sort)
    # the switch before this row: of the row before in the block, else of the last row of an earlier block
    ends = state.groupBy(*keys, block).agg(F.max_by(on, F.struct(*sort)).alias("_on"))
    carry = ends.select(*keys, block, F.lag("_on").over(Window.partitionBy(*keys).orderBy(block)).alias("_before"))
    rows = _attach(state.withColumn("on", on).withColumn("_was", F.lag(on).over(inside)), carry, [*keys, block])
    was = F.coalesce("_was", "_before", F.lit(True))
    over = (F.col("type") == "message_end") | (F.col("type") == "reset") | ((F.col("type") == "set_config") & was & ~F.col("on"))
    rows = rows.withColumn("_over", over.cast("bigint")).withColumn("_up", (F.col("type") == "set_config") & ~was & F.col("on")).drop("_was", "_before")
    # units and places are running counts over blocks
    count = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = rows.select("*", count("_over", inside).alias("_unit"), F.row_number().over(inside).alias("_row"))
    sums = rows.groupBy(*keys, block).agg(F.sum("_over").alias("_o"), F.count(F.lit(1)).alias("_r"))
    behind = Window.partitionBy(*keys).orderBy(block)
    sums = sums.select(*keys, block, count("_o", behind).alias("_units"), count("_r", behind).alias("_rows"))
    rows = _attach(local, sums, [*keys, block]).withColumn("unit", F.col("_unit") + F.col("_units")).withColumn("pos", F.col("_row") + F.col("_rows"))
    rows = kept(rows.select(*keys, block, row_id, "type", "text", "on", "_over", "_up", "unit", "pos"), "units")

    # what a unit comes to: its last switch, whether it is flushed, and from where on chunks come free
    turns = F.col("_over") == 1
    fate = rows.groupBy(*keys, "unit").agg(
        F.max_by(F.when(~turns | (F.col("type") == "message_end"), F.col("on")), F.when(~turns | (F.col("type") == "message_end"), F.col("pos"))).alias("open"),
        F.coalesce(F.max(F.when(turns & (F.col("type") == "message_end"), F.col("pos"))), F.lit(-1)).alias("flush"),
        F.coalesce(F.max(F.when(F.col("_up"), F.col("pos"))), F.lit(-1)).alias("free"),
        F.max_by(row_id, F.when(turns & (F.col("type") == "message_end"), F.col("pos"))).alias("flush_id"),
        F.max_by(row_id, F.when(F.col("_up"), F.col("pos"))).alias("free_id"),
        F.min(block).alias("_lo"),
        F.max(block).alias("_hi"),
    )
    said = rows.where(F.col("type") == "delta").select(*keys, "unit", block, "pos", row_id, F.coalesce("text", F.lit("")).alias("text"))
    said = _attach(said, fate, [*keys, "unit"]).where("open")
    said = kept(said.select(*keys, "unit", block, "pos", row_id, "text", "flush", "free", "flush_id", "free_id", (F.col("_lo") != F.col("_hi")).alias("spread")), "said")
    part = [*keys, "unit", block]
    shown = [*keys, row_id, "chunk_idx", "chunk"]

    # units of one block are cut at once
    def cut_whole(s: chunking.Unit, row: Row) -> list[Row]:
        return s.feed(*row)

    alone = said.where("NOT spread").select(*keys, "unit", "pos", row_id, "text", "flush", "free", "flush_id", "free_id")
    id_kind = said.schema[row_id].dataType.simpleString()
    done = in_groups(alone, [*keys, "unit"], ["pos"], chunking.Unit, cut_whole, lambda s: s.rest(), _fields(said, [*keys, "unit"], f"{row_id} {id_kind}, chunk_idx bigint, chunk string")).select(shown)
    said = said.where("spread").drop("flush", "free", "flush_id", "free_id", row_id)
    if said.isEmpty():
        return done

    # the state in which each part of a unit of several blocks begins
    marks = in_groups(
        said.select(*part, "pos", "text"), part, ["pos"], chunking.CodeMap, lambda s, r: s.add(r[1]) or [], lambda s: [(s.exits,)], _fields(said, part, "exits array<int>")
    )

    def pass_on(state: list, row: Row) -> list[Row]:
        at, exits = row
        entry, state[0] = state[0], exits[state[0]]
        return [(at, entry)]

    entries = in_groups(marks, [*keys, "unit"], [block], lambda: [0], pass_on, lambda s: [], _fields(said, part, "entry int"))

    # head, chunks and tail of each part
    entered = entries.select(*part, F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("text"), "entry")
    both = said.select(*part, "pos", "text", F.lit(0).alias("entry")).unionByName(entered)

    def cut(s: chunking.Cutter, row: Row) -> list[Row]:
        pos, text, entry = row
        if pos < 0:
            s.enter(entry)
            return []
        return [(*x,) for x in s.feed(pos, text)]

    found = in_groups(
        both, part, ["pos"], chunking.Cutter, cut, lambda s: s.rest(), _fields(said, part, "no bigint, kind int, chunk string, free bigint, sizes array<int>, places array<bigint>")
    )
    found = kept(found, "fragments")

    # kind 1: a whole chunk; 0 head, 2 tail (of a part without a cut the head is all there is)
    whole = found.where("kind = 1").select(*keys, "unit", block, F.lit(1).alias("_part"), "no", "chunk", "free")
    # a head closes the gap that the tail before it opened; the first gap has heads alone
    edges = found.where("kind <> 1")
    cuts = Window.partitionBy(*keys, "unit").orderBy(block, "kind").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("gap", F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("no")).otherwise(0)).over(cuts), F.lit(0)))
    edges = _attach(edges, fate.select(*keys, "unit", "flush"), [*keys, "unit"])
    last_gap = edges.groupBy(*keys, "unit").agg(F.max("gap").alias("_last"))
    edges = _attach(edges, last_gap, [*keys, "unit"])
    gap = [*keys, "unit", "gap"]
    joined = in_groups(
        edges.select(*gap, block, "kind", "chunk", "free", "sizes", "places", "flush", (F.col("gap") == F.col("_last")).alias("open")),
        gap,
        [block, "kind"],
        chunking.Joint,
        lambda s, r: s.add(*r) or [],
        lambda s: s.chunks(),
        _fields(edges, gap, f"{block} bigint, no bigint, chunk string, free bigint"),
    )
    met = joined.select(*keys, "unit", block, F.when(F.col("gap") == 0, 0).otherwise(2).alias("_part"), "no", "chunk", "free")
    chunks = _attach(whole.unionByName(met), fate.select(*keys, "unit", F.col("free").alias("_free")), [*keys, "unit"])
    chunks = chunks.withColumn("pos", F.greatest("free", "_free"))

    # number the chunks of a unit: within a block, then on from the blocks before
    spot = Window.partitionBy(*keys, "unit", block).orderBy("_part", "no")
    earlier = Window.partitionBy(*keys, "unit").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    numbered = _attach(chunks.withColumn("_k", F.row_number().over(spot)), sizes, part).withColumn("chunk_idx", F.col("_k") + F.col("_ahead") - 1)
    at = rows.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("pos").alias("_pos"), row_id)
    same = F.col("pos") == F.col("_pos")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return done.unionByName(numbered.join(at, same).select(*keys, row_id, F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk"))


# ---- distinct regions

def _widened(cells: Column, value: str, side: float) -> Column:
    """Each cell with one more coordinate: that of the value and its two neighbours."""
    here = F.floor(F.col(value) / side)
    own = F.array(here - 1, here, here + 1)
    return F.flatten(F.transform(cells, lambda cell: F.transform(own, lambda x: F.concat(cell, F.array(x)))))


#: Rows of a group that are decided in one round; they are the first ones in row order.
HEAD = 2_000


def distinct_regions(samples: DataFrame, keys: Sequence[str], row_id: str, features: Sequence[str], apart: float = 0.25, head: int = HEAD) -> DataFrame:
    """Greedy centres in row order: a row is one if it lies further than ``apart`` from all centres before it.

    A round takes the first ``head`` open rows of each group (what each task sees of a group is
    cut to that before the shuffle) and decides them all, in order. Then all other rows within
    reach of a new centre are dropped, by an equi-join on cells of side ``apart``: a centre is
    copied to its own and the neighbouring cells. The first open row is always a centre, and
    how many centres there can be is bounded by the room, so rounds are few however many rows
    there are. Rows with a null or NaN feature are compared with none and are all centres.
    """
    own = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    values = [f"_f{i}" for i in range(len(features))]
    unknown = F.lit(False)
    for v in values:
        unknown = unknown | F.col(v).isNull() | F.isnan(v)
    rows = samples.select(*keys, row_id, *own)
    out = rows.where(unknown).select(*keys, row_id)
    cell = F.array(*[F.floor(F.col(v) / apart) for v in values])
    left = kept(rows.where(~unknown).withColumn("_cell", cell), "samples")
    schema = _fields(rows, [*keys, row_id], ", ".join(f"{v} double" for v in values))

    def decide(first: pd.DataFrame) -> pd.DataFrame:
        first = first.sort_values(row_id, kind="stable")
        points, keep = first[values].to_numpy(dtype=float), []
        open_ = np.ones(len(points), bool)
        for i in range(len(points)):
            if open_[i]:
                keep.append(i)
                square = np.zeros(len(points))
                for k in range(points.shape[1]):  # in the order of the join's sum, so both agree to the last bit
                    square += (points[:, k] - points[i, k]) ** 2
                open_ &= np.sqrt(square) > apart
        return first.iloc[keep][[*keys, row_id, *values]]

    near = F.array(F.array().cast("array<bigint>"))
    for v in values:
        near = _widened(near, v, apart)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(row_id))
    while not left.isEmpty():
        first = left.withColumn("_rank", rank).where(F.col("_rank") <= head)
        centres = kept(first.select(*keys, row_id, *values).groupBy(*keys).applyInPandas(decide, schema), "centres")
        out = out.unionByName(centres.select(*keys, row_id))
        reach = centres.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_c{v}") for v in values], F.explode(near).alias("_at"))
        met = F.col("_cell") == F.col("_at")
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        distance = F.sqrt(sum(((F.col(v) - F.col(f"_c{v}")) * (F.col(v) - F.col(f"_c{v}")) for v in values), F.lit(0.0)))
        left = kept(left.join(reach, met & (distance <= apart), "left_anti"), "samples")
    return out
