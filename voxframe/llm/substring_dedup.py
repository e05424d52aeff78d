"""Substring dedup: FM-index shards answer, for every window of a document, whether its words stand earlier."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import small_side, stored
from voxframe.llm.fm_index import FMIndex
from voxframe.llm.words import _WORD, ranges, slices, sums, words

#: Length of the word n-grams that windows are routed by.
GRAM = 4
#: Distinct segments that may share a route; beyond it they travel window by window.
ROUTE_SEGMENTS = 2_000
#: Words after which a task closes a shard and begins the next.
SHARD_WORDS = 1_000_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments_of(w, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first word, words, route, content hash, whether the route's gram occurs twice) of maximal runs of windows whose smallest gram is the same.

    Equal windows have the same smallest gram, wherever they stand, so they take one route.
    """
    n = w.counts
    per = np.maximum(n - window + 1, 0)
    if not per.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    start = ranges(w.first[:-1], per)
    text = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(w.hash) - gram + 1)
    grams = sums(w.hash, _WORD, at, at + gram)
    route = sliding_min(grams, window - gram + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (route[1:] != route[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(start)]])) + window - 1
    first = start[head]
    content = sums(w.hash, _WORD, first, first + size)
    inside = size - gram + 1
    hits = grams[ranges(first, inside)] == np.repeat(route[head], inside)
    twice = np.add.reduceat(hits, np.cumsum(inside) - inside, dtype=np.int64) > 1
    return text[head], first - w.first[:-1][text[head]], size, route[head].view(np.int64), content.view(np.int64), twice


def _route(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in slices(batch.column("text")):
                text, first, size, route, content, twice = segments_of(words(data, offsets), window, GRAM)
                at = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("tie").take(at), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(route), pa.array(content), pa.array(twice)],
                    ["doc", "tie", "start", "n", "route", "content", "twice"],
                )

    return run


def _met():
    """Of rows sorted by route, content and place: those that share a route, and whether they are the first of their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the previous row
        held: pa.RecordBatch | None = None  # that row itself, if it waits for its next
        lead = np.zeros(3, np.int64)  # the first place of the content at hand

        def out(batch: pa.RecordBatch, keep: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            at = pa.array(np.flatnonzero(keep))
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(first[keep])], [*batch.schema.names, "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            route, content = (batch.column(c).to_numpy() for c in ("route", "content"))
            same = np.zeros(len(route), bool)
            same[1:] = route[1:] == route[:-1]
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "tie", "start")])
            # rows that repeat a document repeat its places; they are no later places
            fresh = np.ones(len(route), bool)
            fresh[1:] = ~same[1:] | (content[1:] != content[:-1])
            if last is not None and last[0] == route[0]:
                same[0] = True
                fresh[0] = last[1] != content[0]
            leader = np.maximum.accumulate(np.where(fresh, np.arange(len(route)), -1))
            top = np.where(leader[None] >= 0, place[:, leader], lead[:, None])
            fresh |= (place == top).all(axis=0)
            lead = top[:, -1]
            # a segment that holds its gram twice may repeat itself
            keep = same | batch.column("twice").to_numpy(zero_copy_only=False)
            keep[:-1] |= same[1:]
            if held is not None and same[0]:
                yield out(held, np.ones(1, bool), np.ones(1, bool))
            held = None if keep[-1] else batch.slice(len(route) - 1, 1)
            last = (route[-1], content[-1])
            yield out(batch, keep, fresh)

    return run


def _cut(window: int):
    """The words of each wanted segment; those of a crowded route window by window, each routed by its own words and dealt over salts by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for doc, tie, text, wanted in zip(part.column("doc").to_pylist(), part.column("tie").to_pylist(), part.column("text"), part.column("wanted").to_pylist()):
                    own = text.as_py().encode().split()
                    for x in wanted:
                        start, n, salts = x["start"], x["n"], x["salts"]
                        if not salts:
                            rows.append((x["route"], 0, doc, tie, start, b" ".join(own[start : start + n])))
                            continue
                        for s in range(start, start + n - window + 1):
                            piece = b" ".join(own[s : s + window])
                            rows.append((int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True), 1 + hash((doc, tie, s)) % salts, doc, tie, s, piece))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["route", "salt", "doc", "tie", "start", "words"])

    return run


def earlier_windows(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window whose words stand earlier among the segments of the shard."""
    data, offsets = next(((d, o) for _, _, d, o in slices(texts, 1 << 62)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    w = words(data, offsets)
    n = w.counts
    # each segment, then a 0
    code = np.unique(w.hash, return_inverse=True)[1] + 1
    text = np.zeros(len(code) + len(n), np.int64)
    shift = np.repeat(np.arange(len(n)), n)
    text[np.arange(len(code)) + shift] = code
    index = FMIndex(text, window)
    per = np.maximum(n - window + 1, 0)
    place = ranges(w.first[:-1] + np.arange(len(n)), per)
    owner = np.repeat(np.arange(len(n)), per)
    low, high = index.search(text, place + window, window)
    # every place of the shard in the order of documents
    segment = np.repeat(np.arange(len(n)), n + 1)
    offset = np.arange(len(text)) - (w.first[:-1] + np.arange(len(n)))[segment]
    order = np.lexsort([start[segment] + offset, tie[segment], doc[segment]])
    rank = np.empty(len(text), np.int64)
    key = np.stack([doc[segment], tie[segment], start[segment] + offset])[:, order]
    rank[order] = np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else 0
    met = np.flatnonzero(high > low)
    if not len(met):
        return owner[:0], place[:0]
    # windows of one length have equal or disjoint intervals
    lows, which = np.unique(low[met], return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[which] = high[met]
    by_suffix = np.append(rank[index.suffixes], np.iinfo(np.int64).max)
    earliest = np.minimum.reduceat(by_suffix, np.stack([lows, highs], axis=1).reshape(-1))[::2]
    late = met[rank[place[met]] > earliest[which]]
    return owner[late], offset[place[late]]


#: What a search gives: spans, and salted windows with no earlier place in their shard, which have words.
FOUND = "doc long, tie int, start int, end int, route long, words binary"


def _search(window: int, last: bool = False):
    """Spans of windows that stand earlier in their shard. Unless this is the last search, salted windows that do not are given back, to meet those of other salts."""

    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        doc, tie, start = (table.column(c).to_numpy() for c in ("doc", "tie", "start"))
        owner, offset = earlier_windows(doc, tie, start, table.column("words"), window)
        # neighbouring windows make one span
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(np.concatenate([head, [len(owner)]])).astype(np.int32) + window - 1
        at = owner[head]
        begin = (start[at] + offset[head]).astype(np.int32)
        # a salted row is one window
        stay = np.zeros(len(doc), bool) if last else table.column("salt").to_numpy() > 0
        stay[owner] = False
        back = np.flatnonzero(stay)
        columns = [np.concatenate([x, y]) for x, y in ((doc[at], doc[back]), (tie[at], tie[back]), (begin, start[back]), ((begin + size).astype(np.int32), start[back] + np.int32(window)))]
        none = len(at)
        route = pa.concat_arrays([pa.nulls(none, pa.int64()), table.column("route").take(pa.array(back)).combine_chunks().cast(pa.int64())])
        texts = pa.concat_arrays([pa.nulls(none, pa.binary()), table.column("words").take(pa.array(back)).combine_chunks().cast(pa.binary())])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), route, texts], ["doc", "tie", "start", "end", "route", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            route = batch.column("route").to_numpy()
            lengths = np.diff(np.frombuffer(batch.column("words").cast(pa.large_binary()).buffers()[1], np.int64)[: batch.num_rows + 1]) // 5
            at = 0
            salt = batch.column("salt").to_numpy()
            # a shard may end where the route or the salt changes
            for cut in np.flatnonzero((route[1:] != route[:-1]) | (salt[1:] != salt[:-1])) + 1:
                if size + int(lengths[at:cut].sum()) >= SHARD_WORDS:
                    held.append(batch.slice(at, cut - at))
                    yield shard(held)
                    held, size, at = [], 0, int(cut)
            held.append(batch.slice(at))
            size += int(lengths[at:].sum())
        if sum(b.num_rows for b in held):
            yield shard(held)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        spans = batch.column("spans")
        for text, span in zip(batch.column("text"), spans):
            own = text.as_py().encode().split()
            counts.append(len(own))
            cut = span.as_py()
            if cut:
                stay, at = [], 0
                for x in sorted((x["start"], x["end"]) for x in cut):
                    stay += own[at : x[0]] if x[0] > at else []
                    at = max(at, x[1])
                own = stay + own[at:]
            removed.append(counts[-1] - len(own))
            kept.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
        )


def substring_dedup(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    Words are cut at white space (space and \\t to \\r). A word goes if it lies in a window of
    `window` words whose words also start earlier: in a document of smaller id, or earlier in
    the same one. Null and empty texts have no words. A null id comes after all others. Rows
    that share an id are told apart by their text (by its hash among themselves); rows that
    repeat both are one document, returned for each. Further columns are ignored.

    Windows travel as segments, runs that share their smallest n-gram (the route), so equal
    windows meet in one shard while a document is spread over many. Routes that only one
    segment takes are dropped. A segment's words are fetched for its first place only; its
    later places are answered with it. Each shard indexes its segments in a compressed
    FM-index and streams them against it by backward search; the interval of a window gives
    its earliest place. A route with too many different segments is dissolved into windows,
    routed by all their words and dealt over salts, whose number grows with the segments. A
    window with an earlier place under its salt is settled; the one that is left for each
    salt is searched again among those of the other salts. So a window that k segments hold
    makes groups of about ROUTE_SEGMENTS rows, then one of k / ROUTE_SEGMENTS.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = own.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    tie = F.lit(0) if ids["rows"] == ids["ids"] else F.hash("text")
    own = own.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), tie.alias("tie"), "text")
    routed = own.select("doc", "tie", "text").mapInArrow(_route(window), "doc long, tie int, start int, n int, route long, content long, twice boolean")
    met = stored(
        routed.repartition("route").sortWithinPartitions("route", "content", "doc", "tie", "start").mapInArrow(_met(), routed.schema.add("first", "boolean")),
        "segments",
    )
    first = met.where("first")
    crowded = first.groupBy("route").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > ROUTE_SEGMENTS)
    crowded = crowded.select("route", F.ceil(F.col("k") / ROUTE_SEGMENTS).cast("int").alias("salts"))
    wanted = (
        first.join(small_side(crowded), "route", "left")
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("start", "n", "route", F.coalesce("salts", F.lit(0)).alias("salts"))).alias("wanted"))
    )
    found = stored(
        own.select("doc", "tie", "text")
        .join(wanted, ["doc", "tie"])
        .mapInArrow(_cut(window), "route long, salt int, doc long, tie int, start int, words binary")
        .repartition("route", "salt")
        .sortWithinPartitions("route", "salt")
        .mapInArrow(_search(window), FOUND),
        "spans",
    )
    left = found.where("words IS NOT NULL").select("route", F.lit(0).alias("salt"), "doc", "tie", "start", "words")
    met_again = left.repartition("route").sortWithinPartitions("route").mapInArrow(_search(window, last=True), FOUND)
    found = found.where("words IS NULL").unionByName(met_again).select("doc", "tie", "start", "end")
    # a later place of a segment is later in all its windows
    again = met.where("NOT first").select("doc", "tie", "start", (F.col("start") + F.col("n")).alias("end"))
    spans = found.unionByName(again).groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return own.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")
