"""Byte-level BPE: every merge is replayed in rank order over the distinct pieces of a corpus slice."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.words import ranges, slices


@dataclass
class Merges:
    """A rank file as arrays: what two neighbouring tokens become, and the bytes of each token."""

    byte_id: np.ndarray  # the token of each byte
    keys: np.ndarray  # hash table: left << 32 | right, -1 where empty
    values: np.ndarray  # the token that the pair becomes
    start: np.ndarray  # of each token in data
    size: np.ndarray
    data: np.ndarray

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.keys).bit_length() - 1
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def become(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair of neighbours, -1 where they don't merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


def read_merges(path: str) -> Merges:
    """Read a rank file (base64 token and rank a line). Every pair of tokens that joins to a token is a merge."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    size = np.array([len(t) for t in tokens], np.int64)
    slots = 1 << max(4, (3 * len(pairs)).bit_length())
    out = Merges(
        np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        np.full(slots, -1, np.int64),
        np.full(slots, -1, np.int32),
        np.cumsum(size) - size,
        size,
        np.frombuffer(b"".join(tokens), np.uint8),
    )
    keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
    at = out._slot(keys)
    while len(keys):
        free = out.keys[at] < 0
        first = np.zeros(len(keys), bool)
        first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
        put = free & first
        out.keys[at[put]], out.values[at[put]] = keys[put], values[put]
        keys, values, at = keys[~put], values[~put], (at[~put] + ~free[~put]) % slots
    return out


def replay(data: np.ndarray, offsets: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of the pieces data[offsets[i]:offsets[i+1]] after all merges.

    `where` is the inverted index from a pair (named by what it becomes, its rank) to the
    positions of its left token. The lowest rank on hand is taken, its leftmost place in each
    piece is merged, and only the pairs on either side are looked up anew. Further places of
    the rank in the same piece wait for the next turn, as a merge may bring a lower rank.
    """
    n = len(data)
    piece = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    token = merges.byte_id[data]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = -1
    after[(offsets[1:] - 1)[np.diff(offsets) > 0]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, -1, np.int32)
    where: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def look(at: np.ndarray) -> None:
        """Look up the pairs that begin at these positions and enter them into the index."""
        nxt = after[at]
        has = nxt >= 0
        pair[at[~has]] = -1
        at, nxt = at[has], nxt[has]
        got = merges.become(token[at], token[nxt])
        pair[at] = got
        at, got = at[got >= 0], got[got >= 0]
        if not len(at):
            return
        order = np.argsort(got, kind="stable")
        at, got = at[order], got[order]
        cuts = np.flatnonzero(got[1:] != got[:-1]) + 1
        for r, part in zip(got[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r not in where:
                where[r] = []
                heapq.heappush(ranks, r)
            where[r].append(part)

    for at in range(0, n, 1 << 18):  # in stretches, which bounds what the look-up holds
        look(np.arange(at, min(n, at + (1 << 18)), dtype=np.int64))
    while ranks:
        rank = heapq.heappop(ranks)
        lists = where.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[pair[at] == rank]
        if not len(at):
            continue
        owner = piece[at]
        lead = np.ones(len(at), bool)
        lead[1:] = owner[1:] != owner[:-1]
        if not lead.all():
            where[rank] = [at[~lead]]
            heapq.heappush(ranks, rank)
            at = at[lead]
        right = after[at]
        following = after[right]
        token[at] = rank
        after[at] = following
        alive[right] = False
        pair[right] = -1
        on = following >= 0
        before[following[on]] = at[on]
        left = before[at]
        look(np.concatenate([left[left >= 0], at]) if (left >= 0).any() else at)
    counts = np.bincount(piece[alive], minlength=len(offsets) - 1) if n else np.zeros(len(offsets) - 1, np.int64)
    return token[alive], np.concatenate([[0], np.cumsum(counts)])


def _shared(docs: DataFrame, path: str):
    """The rank table as plain arrays: a broadcast is read by executors that may have no copy of this package."""
    return docs.sparkSession.sparkContext.broadcast(vars(read_merges(path)))


def _codes(merges, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Merges(**merges.value)
        split = regex.compile(pattern)
        for batch in batches:
            texts = batch.column("text")
            for row, stop, data, _ in slices(texts, 1 << 23):
                parts, counts, held, kept = [], [], [], 0
                for text in texts.slice(row, stop - row):
                    found = split.findall(text.as_py() or "")
                    counts.append(len(found))
                    held += found
                    if len(held) > 100_000:
                        parts.append(pa.array(held, pa.string()))
                        held = []
                parts.append(pa.array(held, pa.string()))
                held = []
                # the corpus of this slice: each distinct piece once
                coded = pa.chunked_array(parts).combine_chunks().dictionary_encode()
                parts = []
                coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
                pieces = coded.dictionary.cast(pa.large_binary())
                offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
                raw = np.frombuffer(pieces.buffers()[2], np.uint8)[: offsets[-1]] if len(pieces) else np.zeros(0, np.uint8)
                tokens, first = replay(raw, offsets, table)
                index = coded.indices.to_numpy(zero_copy_only=False)
                tokens = tokens.astype("<u4")
                ids, decoded = [], []
                for n in counts:
                    at = index[kept : kept + n]
                    kept += n
                    own = tokens[ranges(first[at], first[at + 1] - first[at])]
                    ids.append(own.tobytes())
                    decoded.append(table.data[ranges(table.start[own], table.size[own])].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, stop - row) for c in batch.schema.names if c != "text"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    [*(c for c in batch.schema.names if c != "text"), "ids", "decoded"],
                )

    return run


def byte_bpe(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit integers), decoded (the bytes the ids stand for).

    `path` is a rank file, `pattern` what cuts a text into pieces; each piece is encoded by
    itself. No token is special. Null and empty texts give no ids and no bytes. Repeated rows
    and null ids are returned as they are; further columns are ignored; no rows give no rows.

    Rank tables are read by the driver and broadcast (a vocabulary, whose size does not depend
    on the corpus). A task replays the merges over the distinct pieces of about 8 MB of text
    at a time, so memory is bounded, nothing is shuffled and a lost task is simply run again.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        _codes(_shared(docs, path), pattern), "doc_id long, ids binary, decoded binary"
    )


def decode(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of little-endian unsigned 32-bit ids; null gives none."""
    merges = _shared(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Merges(**merges.value)
        for batch in batches:
            own = [np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column("ids")]
            out = [table.data[ranges(table.start[x], table.size[x])].tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
