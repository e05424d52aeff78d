"""Suffix-array dedup: suffixes at minimiser positions are sorted, neighbours compared and matches extended both ways; windows they miss are found by hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import stored
from voxframe.llm.substring_dedup import segments_of, sliding_min
from voxframe.llm.words import _WORD, Words, mix, ranges, slices, sums, words

#: Words of the n-gram at a retained suffix.
GRAM = 8
#: Suffixes with one n-gram beyond which they are dealt out by the words that follow and, once more, by those before.
CROWD = 2_000
#: Suffixes a task sorts and compares at a time, and neighbours each is compared with.
SORT_ROWS, NEAR = 20_000, 4
#: What a task of suffixes gives: spans of neighbours, and the segments that pass through it, told by a hash of their words.
FOUND = "doc long, tie int, start int, end int, other long, other_start int, route long, content long, twice boolean, hashes array<long>"


def samples_of(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, n-gram hash) of the suffixes kept: the smallest n-gram of any window of the text begins there."""
    n = w.counts
    per = np.maximum(n - window + 1, 0)
    if not per.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(w.hash) - gram + 1)
    grams = sums(w.hash, _WORD, at, at + gram)
    width = window - gram + 1
    start = ranges(w.first[:-1], per)
    least = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
    least[start] = sliding_min(grams, width)[start]
    # a word is kept if its n-gram is the smallest of one of the windows around it, which begin up to width - 1 words before
    kept = np.zeros(len(grams), bool)
    for back in range(width):
        kept[back:] |= grams[back:] == least[: len(least) - back]
    word = np.flatnonzero(kept)
    text = np.searchsorted(w.first, word, "right") - 1
    # words that repeat with a short period keep the n-gram at every turn: the first two, the last two (a run
    # also repeats itself) and one in a while will do
    linked = (grams[word][1:] == grams[word][:-1]) & (np.diff(word) <= gram) & (text[1:] == text[:-1])
    opens, closes = np.append(True, ~linked), np.append(~linked, True)
    turn = (word - word[opens][np.cumsum(opens) - 1]) // max(1, window - 2 * gram)
    stay = opens | closes | np.append(True, turn[1:] != turn[:-1])
    stay[1:] |= opens[:-1]
    stay[:-1] |= closes[1:]
    word, text = word[stay], text[stay]
    return text, word - w.first[:-1][text], grams[word]


def _sample(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in slices(batch.column("text")):
                text, word, gram = samples_of(words(data, offsets), window, GRAM)
                at = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("tie").take(at), pa.array(word.astype(np.int32)), pa.array(gram.view(np.int64))], ["doc", "tie", "pos", "route"]
                )

    return run


def _cut(window: int):
    """The words before and after each suffix, those before in reverse, so that both run away from it; and the segments of its n-gram with a hash of each window."""
    kind = pa.schema(
        [("route", pa.int64()), ("doc", pa.int64()), ("tie", pa.int32()), ("pos", pa.int32()), ("right", pa.binary()), ("left", pa.binary())]
        + [("end", pa.int32()), ("gram", pa.int64()), ("content", pa.int64()), ("twice", pa.bool_()), ("hashes", pa.list_(pa.int64()))]
    )

    def batch_of(columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    def segments(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, end, data, offsets in slices(part.column("text")):
            w = words(data, offsets)
            text, first, size, gram, content, twice = segments_of(w, window, GRAM)
            # of each text the n-grams that others share
            wanted = part.column("wanted").slice(row, end - row)
            owner = np.repeat(np.arange(end - row), wanted.value_lengths().to_numpy(zero_copy_only=False))
            shared = np.unique(np.stack([owner, wanted.flatten().field("route").to_numpy()], axis=1), axis=0)
            known = np.zeros(len(text), bool)
            keys = np.ascontiguousarray(shared).view([("t", np.int64), ("g", np.int64)]).reshape(-1)
            own = np.ascontiguousarray(np.stack([text, gram], axis=1)).view(keys.dtype).reshape(-1)
            known = np.isin(own, keys) if len(own) else known
            text, first, size, gram, content, twice = (x[known] for x in (text, first, size, gram, content, twice))
            if not len(text):
                continue
            per = size - window + 1
            start = ranges(w.first[:-1][text] + first, per)
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(sums(w.hash, _WORD, start, start + window).view(np.int64)))
            at = pa.array(text + row)
            doc, tie = part.column("doc").take(at), part.column("tie").take(at)
            # they only pass through, so they are spread evenly
            spread = mix(content.view(np.uint64) ^ mix(doc.to_numpy().view(np.uint64) + first.astype(np.uint64))).view(np.int64)
            yield batch_of([spread, doc, tie, first.astype(np.int32), None, None, (first + size).astype(np.int32), gram, content, twice, hashes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for doc, tie, text, wanted in zip(part.column("doc").to_pylist(), part.column("tie").to_pylist(), part.column("text"), part.column("wanted").to_pylist()):
                    own = text.as_py().encode().split()
                    for x in wanted:
                        pos, route = x["pos"], x["route"]
                        right, left = own[pos : pos + window], own[max(0, pos - window + 1) : pos][::-1]
                        row = (doc, tie, pos, b" ".join(right), b" ".join(left))
                        if not x["crowded"]:
                            rows.append((route, *row))
                            continue
                        # a match of a whole window goes on for 2 * GRAM words after the suffix or for GRAM before it
                        rows.append((hash_of(right[: 2 * GRAM], 1), *row))
                        if len(left) >= GRAM:
                            rows.append((hash_of(right[:GRAM] + left[:GRAM], 2), *row))
                yield batch_of([*([r[i] for r in rows] for i in range(6)), *[None] * 5])
                yield from segments(part)

    def hash_of(parts: list[bytes], kind: int) -> int:
        return int.from_bytes(hashlib.blake2b(b" ".join(parts), digest_size=8, person=bytes([kind])).digest(), "little", signed=True)

    return run


def _matrix(column: pa.Array, width: int, salt: int) -> np.ndarray:
    """Word hashes by row; what a row lacks differs from everything."""
    data, offsets = next(((d, o) for _, _, d, o in slices(column, 1 << 62)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    w = words(data, offsets)
    n = np.minimum(w.counts, width)
    out = mix(np.arange(len(column) * width, dtype=np.uint64) + np.uint64(salt << 40)).reshape(len(column), width)
    out[np.repeat(np.arange(len(column)), n), ranges(np.zeros(len(column), np.int64), n)] = w.hash[ranges(w.first[:-1], n)]
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of a and b."""
    differs = a != b
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def neighbour_matches(route: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, right: np.ndarray, left: np.ndarray, window: int) -> list[np.ndarray]:
    """(row, words before, words after, other row) of each suffix's longest match of at least `window` words.

    Rows come in suffix order. They are compared with the NEAR rows beside them, once in this
    order and once in that of the words before; ties go to the smallest other document.
    """
    n = len(route)
    best = np.zeros(n, np.int64)
    found = np.zeros((3, n), np.int64)
    nested = [np.bitwise_xor.reduce(mix(left[:, :k] + np.arange(k, dtype=np.uint64)), axis=1) for k in (32, 16, 8, 4, 2) if k < window]
    for order in (np.arange(n), np.lexsort([*nested, route])):
        for step in range(1, NEAR + 1):
            a, b = order[:-step], order[step:]
            same = (route[a] == route[b]) & ~((doc[a] == doc[b]) & (tie[a] == tie[b]) & (pos[a] == pos[b]))
            a, b = a[same], b[same]
            after, before = _shared(right[a], right[b]), _shared(left[a], left[b])
            long = after + before >= window
            a, b, after, before = a[long], b[long], after[long], before[long]
            for x, y in ((a, b), (b, a)):
                more = (after + before > best[x]) | ((after + before == best[x]) & (doc[y] < doc[found[2, x]]))
                at = x[more]
                best[at] = (after + before)[more]
                found[:, at] = before[more], after[more], y[more]
    rows = np.flatnonzero(best)
    return [rows, *found[:, rows]]


def _compare(window: int):
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    kind = pa.schema(list(zip([x.split()[0] for x in FOUND.split(", ")], types)))

    def chunk(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        route, doc, tie, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("route", "doc", "tie", "pos"))
        right, left = _matrix(table.column("right"), window, 1), _matrix(table.column("left"), window - 1, 2)
        row, before, after, other = neighbour_matches(route, doc, tie, pos, right, left, window)
        columns = (doc[row], tie[row], pos[row] - before, pos[row] + after, doc[other], pos[other] - before)
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)), *(pa.nulls(len(row), t) for t in types[6:])], schema=kind)

    def passing(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(batch.num_rows, t) for t in types[4:6]]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "tie", "pos", "end")), *none, *(batch.column(c) for c in ("gram", "content", "twice", "hashes"))], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            segment = batch.column("right").is_null()
            if segment.true_count:
                yield passing(batch.filter(segment))
            batch = batch.filter(pa.array(~segment.to_numpy(zero_copy_only=False))).select(["route", "doc", "tie", "pos", "right", "left"])
            if not batch.num_rows:
                continue
            route = batch.column("route").to_numpy()
            at = 0
            for cut in (np.flatnonzero(route[1:] != route[:-1]) + 1).tolist():
                if size + cut - at >= SORT_ROWS:
                    yield chunk([*held, batch.slice(at, cut - at)])
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += batch.num_rows - at
            if size >= 2 * SORT_ROWS:  # one n-gram goes on: its next rows meet the last of these
                yield chunk(held)
                held, size = [batch.slice(max(at, batch.num_rows - NEAR))], min(NEAR, batch.num_rows - at)
        if size:
            yield chunk(held)

    return run


def _other(low: str, high: str, place: Column) -> Column:
    """The least place, or the greatest where the least is the row's own."""
    return F.when(F.col(low) == place, F.col(high)).otherwise(F.col(low))


def exact_spans(segments: DataFrame, window: int) -> DataFrame:
    """doc, tie, start, end, other, other_start of every window that also stands elsewhere, of segments that share their n-gram.

    Equal windows have the same smallest n-gram. Equal segments are told by a hash of all
    their words, the windows of the different ones by a hash of theirs; both aggregate to the
    least and greatest place before the shuffle, so a passage that a third of all documents
    hold is one row for each task.
    """
    place = F.struct("doc", "tie", "start")
    equal = segments.groupBy("route", "content").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("twice").alias("twice"))
    equal = stored(equal, "equal-segments")
    again = segments.select("doc", "tie", "start", "end", "route", "content").join(equal.where("low < high"), ["route", "content"])
    other = _other("low", "high", place)
    again = again.select("doc", "tie", "start", "end", other["doc"].alias("other"), other["start"].alias("other_start"))
    # the windows of one segment for each content, where another content or the segment itself may hold them again
    several = equal.groupBy("route").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("any")).where("k > 1 OR any").select("route")
    chosen = equal.join(several, "route", "left_semi").select("route", "content", "low.*", (F.col("low") == F.col("high")).alias("single"))
    windows = segments.select("doc", "tie", "start", "route", "content", "hashes").join(chosen, ["doc", "tie", "start", "route", "content"])
    windows = windows.select("doc", "tie", "single", "route", "start", F.posexplode("hashes").alias("k", "hash")).select("doc", "tie", "single", "route", "hash", (F.col("start") + F.col("k")).alias("start"))
    windows = stored(windows, "windows")
    met = windows.groupBy("route", "hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("single").alias("single"))
    # a table of its own, so that the join may split a hash that very many segments hold
    met = stored(met.where("low < high AND single").select("route", "hash", "low", "high"), "met-windows")
    hits = windows.where("single").join(met, ["route", "hash"]).select("doc", "tie", "start", other.alias("at"))
    shift = F.col("at.start") - F.col("start")
    # windows that begin within one window's length of each other make one span
    hits = hits.groupBy("doc", "tie", F.col("at.doc").alias("other"), F.col("at.tie").alias("other_tie"), shift.alias("shift"), F.floor(F.col("start") / window).alias("stretch"))
    hits = hits.agg(F.min("start").alias("start"), (F.max("start") + window).cast("int").alias("end"))
    return again.unionByName(hits.select("doc", "tie", "start", "end", "other", (F.col("start") + F.col("shift")).alias("other_start")))


def suffix_dedup(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated passage of a document: doc_id, start_word, end_word, n_words, other_id, other_start.

    A passage is a maximal stretch of words, at least `window` long, every part of which also
    stands elsewhere, in another document or in the same one; other_id and other_start tell
    the longest such place found, for ties the smallest document's. Words are cut at white
    space. Documents without such passages, null and empty texts give no rows; copies give
    their whole text. A null id stays null. Rows that share an id are told apart by the hash
    of their text; rows that repeat both give one set of passages and do not count as each
    other's repeats. Further columns are ignored.

    Of every `window` words at least one suffix is kept, chosen by content (the smallest
    n-gram hash), so a repeated passage keeps the same suffixes in all its places. Suffixes
    whose first n-gram no other shares are dropped; the rest fetch `window` words either way,
    are sorted within the partition of their n-gram and compared with their neighbours. What
    neighbours miss is found exactly: every window whose smallest n-gram another place shares
    is looked up by its hash (exact_spans), and a passage is the union of all of them.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = own.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    tie = F.lit(0) if ids["rows"] == ids["ids"] else F.hash("text")
    none = F.lit((1 << 63) - 1)
    own = own.select(F.coalesce("doc_id", none).alias("doc"), tie.alias("tie"), "text")
    sampled = own.mapInArrow(_sample(window), "doc long, tie int, pos int, route long")
    counts = sampled.groupBy("route").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    met = stored(sampled.join(counts, "route").select("doc", "tie", "pos", "route", (F.col("k") > CROWD).alias("crowded")), "suffixes")
    wanted = met.groupBy("doc", "tie").agg(F.collect_set(F.struct("pos", "route", "crowded")).alias("wanted"))
    found = stored(
        own.join(wanted, ["doc", "tie"])
        .mapInArrow(_cut(window), "route long, doc long, tie int, pos int, right binary, left binary, end int, gram long, content long, twice boolean, hashes array<long>")
        .repartition("route")
        .sortWithinPartitions("route", "right")
        .mapInArrow(_compare(window), FOUND),
        "spans",
    )
    near = found.where("content IS NULL").select("doc", "tie", "start", "end", "other", "other_start")
    longs = [F.col(c).cast("long").alias(c) for c in ("doc", "tie", "start", "end", "other", "other_start")]
    spans = near.unionByName(exact_spans(found.where("content IS NOT NULL"), window)).select(longs)
    # spans of a document that overlap are parts of one passage
    by_start = Window.partitionBy("doc", "tie").orderBy("start", F.desc("end"))
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select("*", F.when(reach >= F.col("start"), 0).otherwise(1).alias("fresh"))
    parts = fresh.select("*", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))
    longest = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("other")).alias("smallest"), "other", (F.col("other_start") - F.col("start")).alias("shift"))
    passages = parts.groupBy("doc", "tie", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max(longest).alias("best"))
    return passages.select(
        F.nullif("doc", none).alias("doc_id"),
        "start_word",
        "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.nullif("best.other", none).alias("other_id"),
        F.greatest(F.lit(0).cast("long"), F.col("start_word") + F.col("best.shift")).alias("other_start"),
    )
