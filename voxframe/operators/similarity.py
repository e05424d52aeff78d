"""Similarity of every queried vector with all others: candidates by random hyperplanes, as many as pay, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators.recursions import kept

#: Vectors of a block; queries and rows of a larger bucket meet block by block.
BLOCK = 2048
#: Microseconds to bring a row to a bucket, to bring its vector there, and to compare two vectors.
SLOT_US, MEMBER_US, PAIR_US = 2.0, 15.0, 0.02


def banding(rows: int, threshold: float, recall: float, bits: int | None = None) -> tuple[int, int]:
    """(bits a band, bands): a pair at the threshold shares a band with this probability; without given bits, unrelated vectors are mostly alone in a bucket."""
    if bits == 0:
        return 0, 1
    same = 1.0 - math.acos(threshold) / math.pi
    bits = min(40, max(6, math.ceil(math.log2(max(rows, 2))) + 1)) if bits is None else bits
    return bits, math.ceil(math.log(1.0 - recall) / math.log1p(-(same**bits)))


def cheapest_banding(rows: int, asks: int, threshold: float, recall: float, block: int = BLOCK) -> tuple[int, int]:
    """(bits a band, bands) of the least work; no bits, where all queries meet all rows, while that is the least.

    Long bands leave few vectors to compare but must be many, and each brings every row to a
    bucket. Comparing costs far less than bringing, so buckets as large as a few blocks pay.
    """

    def work(bits: int) -> float:
        bands, given, asking = banding(rows, threshold, recall, bits)[1], rows / 2**bits, asks / 2**bits
        members = rows * -math.expm1(-asking) * max(1.0, asking / block) + asks * max(1.0, given / block)
        return bands * (SLOT_US * rows + MEMBER_US * members + PAIR_US * rows * asking)

    return banding(rows, threshold, recall, min(range(41), key=work))


def signatures(vectors: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """The bucket of each vector in each band: on which side of `bits` hyperplanes it lies."""
    planes = np.random.default_rng([seed, vectors.shape[1]])
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    out = np.empty((len(vectors), bands), np.int64)
    for band in range(bands):
        out[:, band] = ((vectors @ planes.standard_normal((vectors.shape[1], bits))) >= 0) @ weights
    return out


def _signed(bits: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            keys: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:  # vectors of other dimensions are never compared
                own = [i for i, v in enumerate(vectors) if len(v) == size]
                got = signatures(np.array([vectors[i] for i in own], float), bits, bands, seed)
                for i, row in zip(own, (got << 23) + size % (1 << 23), strict=True):
                    keys[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return run


def _compared(threshold: float):
    names = ["first", "links", "similarity", "partner"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        """Lists of one length as the rows of a matrix."""
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)

    def result(band: int, group: pa.Table) -> pa.RecordBatch | None:
        """Columns are asks, first, rows, v, keys; the queries among the rows are met with the others."""
        asks = group.column("asks").to_numpy()
        if asks.all() or not asks.any():
            return None
        asking, given = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        q, r = (matrix(side.column("v"), float) for side in (asking, given))
        q, r = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, r))
        near = np.clip(q @ r.T, -1.0, 1.0)
        own_ids, ids = (side.column("first").to_numpy() for side in (asking, given))
        a, b = np.nonzero(near >= threshold)
        other = own_ids[a] != ids[b]
        a, b = a[other], b[other]
        if band and len(a):  # a pair belongs to the first band that it shares
            ka, kb = (matrix(side.column("keys"), np.int64)[:, :band] for side in (asking, given))
            fresh = np.concatenate([~(ka[a[i : i + 4096]] == kb[b[i : i + 4096]]).any(1) for i in range(0, len(a), 4096)])
            a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        weight, found = given.column("rows").to_numpy(), near[a, b]
        order = np.lexsort((ids[b], -found, a))
        own, at = np.unique(a[order], return_index=True)
        links = np.bincount(a, weight[b], len(asking)).astype(np.int64)
        columns = own_ids[own], links[own], found[order][at], ids[b][order][at]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            if not len(batch):
                continue
            places = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], 1)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1).tolist(), len(batch)]
            for i, j in zip(cuts, cuts[1:]):
                at = tuple(places[i].tolist())
                if at != key:
                    if own and (out := result(key[0], pa.Table.from_batches(own))) is not None:
                        yield out
                    key, own = at, []
                own.append(batch.slice(i, j - i))
        if own and (out := result(key[0], pa.Table.from_batches(own))) is not None:
            yield out

    return run


def similar_vectors(
    df: DataFrame, row_id: str, vector: str, asks: Column, threshold: float = 0.8, recall: float = 0.995, block: int = BLOCK, seed: int = 11
) -> DataFrame:
    """For each row that ``asks``: how many rows have a cosine of at least ``threshold`` with it, and the nearest of them.

    (row_id, n_links, best_id, similarity); without a link 0 and nulls. Of equally near rows
    the one with the smallest id is best; among copies of the vector itself that is the first
    one, for the first one itself the last. Links are verified on the vectors; a link at the
    threshold is found with a probability of ``recall``, nearer ones are surer; as long as
    meeting all rows costs least, all are found. Null, empty and zero vectors have no links.
    Vectors of different dimensions have none with each other.

    Equal vectors are one row with a count. Only ids travel to find the buckets; vectors follow
    for those that hold a query and another vector. A bucket over the size of a block is cut
    into blocks of queries and blocks of rows that meet in groups of their own. A pair counts
    in the first band that it shares, and groups hand back one row for each query.
    """
    named = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("ask"))
    named = kept(named, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sound = (F.size("v") > 0) & (square > 0) & (square < float("inf"))
    distinct = named.where(sound).groupBy("v").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows"), F.max("ask").alias("ask")
    )
    rows, asking = named.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    bits, bands = cheapest_banding(rows, asking, threshold, recall, block)
    schema = "v array<double>, first bigint, last bigint, rows bigint, ask boolean, keys array<bigint>"
    signed = kept(distinct.mapInArrow(_signed(bits, bands, seed), schema), "signed")

    slots = signed.select("first", "ask", F.posexplode("keys").alias("band", "bucket"))
    sizes = slots.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("_n"), F.count_if("ask").alias("_q")).where("_n > 1 AND _q > 0")
    sizes = sizes.select("band", "bucket", F.ceil(F.col("_n") / block).cast("int").alias("_given"), F.ceil(F.col("_q") / block).cast("int").alias("_asking"))
    held = slots.join(sizes, ["band", "bucket"])
    spot = lambda n: F.pmod(F.xxhash64("first"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    given = held.select("band", "bucket", "first", F.lit(False).alias("asks"), spot("_given").alias("lo"), F.explode(every("_asking")).alias("hi"))
    asking = held.where("ask").select("band", "bucket", "first", F.lit(True).alias("asks"), spot("_asking").alias("hi"), F.explode(every("_given")).alias("lo"))
    members = given.unionByName(asking).join(signed.select("first", "rows", "v", "keys"), "first")
    group = ["band", "bucket", "lo", "hi"]
    found = members.select(*group, "asks", "first", "rows", "v", "keys").repartition(*group).sortWithinPartitions(*group)
    found = found.mapInArrow(_compared(threshold), "first bigint, links bigint, similarity double, partner bigint")
    best = found.groupBy("first").agg(F.sum("links").alias("links"), F.max(F.struct("similarity", (-F.col("partner")).alias("partner"))).alias("best"))

    known = signed.where("ask").join(best, "first", "left").select("v", "first", "last", "rows", "links", "best")
    out = named.where("ask").join(known, "v", "left")
    copies = F.coalesce(F.col("rows"), F.lit(1)) - 1
    twin = F.when(copies > 0, F.when(F.col("id") == F.col("first"), F.col("last")).otherwise(F.col("first")))
    return out.select(
        F.col("id").alias(row_id),
        (copies + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce(twin, -F.col("best.partner")).alias("best_id"),
        F.when(copies > 0, 1.0).otherwise(F.col("best.similarity")).alias("similarity"),
    )
