"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import run_of, stored
from voxframe.llm.components import components
from voxframe.llm.words import mix, ranges, slices, words

#: Texts up to which a bucket gives its pairs; larger ones are compared in blocks.
SMALL = 9
#: Texts and n-grams of a block.
BLOCK_ROWS, BLOCK_GRAMS = 10_000, 2_000_000


def choose_bands(similarity: float = 0.8, recall: float = 0.999, hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at `similarity` still meet with probability `recall`.

    More rows a band mean fewer chance meetings; with r rows, n bands find a pair of
    similarity s with probability 1 - (1 - s^r)^n.
    """
    fits = [(n, r) for r in range(1, 33) for n in range(1, hashes // r + 1) if 1 - (1 - similarity**r) ** n >= recall]
    if not fits:
        raise ValueError("not enough hashes for this recall")
    rows = max(r for _, r in fits)
    return min(n for n, r in fits if r == rows), rows


def _signatures(k: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    mul = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    weights = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, bands), np.int64)
            has = np.zeros(batch.num_rows, bool)
            size = np.zeros(batch.num_rows, np.int64)
            for row, stop, data, offsets in slices(batch.column("text"), 1 << 19):
                grams, _, per = words(data, offsets).grams(k)
                some = np.flatnonzero(per)
                if not len(some):
                    continue
                has[row + some] = True
                size[row + some] = per[some]
                first = (np.cumsum(per) - per)[some]
                h = (grams >> np.uint64(32)).astype(np.uint32)
                least = np.empty((len(some), bands * rows), np.uint64)
                for j in range(bands * rows):
                    least[:, j] = np.minimum.reduceat(h * mul[j] + add[j], first)
                band = (least.reshape(len(some), bands, rows) * weights).sum(axis=2, dtype=np.uint64)
                keys[row + some] = mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            at = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[has].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), lists, pa.array(size)], ["id", "digest", "bands", "size"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in slices(batch.column("text")):
                grams, _, per = words(data, offsets).grams(k)
                ends = np.cumsum(per)
                sets = [np.unique(grams[e - n : e]).tobytes() for e, n in zip(ends, per)]
                own = [batch.column(c).slice(row, stop - row) for c in ("id", "large")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.binary())], ["id", "large", "grams"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("grams_a"), batch.column("grams_b")
        out = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
            out[i] = shared / max(1, len(a) + len(b) - shared)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"])


def _block_links(similarity: float, bands: int, each: bool):
    """Links within one block of a bucket, or between two: all of them, or per text their number and a root.

    A pair that shares several large buckets is compared in the first of them alone.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        n, here = len(ids), table.column("i")[0].as_py()
        slots = np.zeros((n, bands), np.int64)
        for row, own in enumerate(table.column("large").to_pylist()):
            for x in own:
                slots[row, x["i"]] = x["bucket"]
        grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams")]
        size = np.array([len(g) for g in grams])
        first = np.cumsum(size) - size
        code = np.unique(np.concatenate(grams), return_inverse=True)[1]
        mark = np.zeros(int(code.max()) + 1, bool)
        lower = part == part.min()
        left = np.flatnonzero(lower)
        right = left if lower.all() else np.flatnonzero(~lower)
        within = right is left
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        links, root = np.zeros(n, np.int64), ids.copy()
        for k, a in enumerate(left):
            to = right[k + 1 :] if within else right
            to = to[np.minimum(size[to], size[a]) >= similarity * np.maximum(size[to], size[a])]
            # the first large bucket of the two
            to = to[~((slots[to, :here] == slots[a, :here]) & (slots[a, :here] != 0)).any(axis=1)]
            if not len(to):
                continue
            own = code[first[a] : first[a] + size[a]]
            mark[own] = True
            shared = np.add.reduceat(mark[code[ranges(first[to], size[to])]], np.cumsum(size[to]) - size[to], dtype=np.int64)
            mark[own] = False
            ratio = shared / (size[to] + size[a] - shared)
            to, ratio = to[ratio >= similarity], ratio[ratio >= similarity]
            if each:
                found.append((np.full(len(to), ids[a]), ids[to], ratio))
            elif len(to):
                links[a] += len(to)
                links[to] += 1
                roots = np.unique(np.append(root[to], root[a]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        if each:
            a, b, ratio = (np.concatenate(x) for x in zip(*found)) if found else (ids[:0], ids[:0], np.zeros(0))
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": ratio})
        met = links > 0
        return pa.table({"id": ids[met], "root": root[met], "n_links": links[met]})

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs of small buckets whose full n-gram sets are similar enough.

    Pairs that also share a large bucket are compared there.
    """
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"), F.col("large").alias("large_a"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"), F.col("large").alias("large_b"))
    met = pairs.join(right, "b").join(left, "a").where(~F.coalesce(F.arrays_overlap("large_a", "large_b"), F.lit(False)))
    return met.select("a", "b", "grams_a", "grams_b").mapInArrow(_similar, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


@dataclass
class Candidates:
    rows: DataFrame  # id, digest, run
    copies: DataFrame  # run, digest, copy_id
    pairs: DataFrame  # a, b: texts of a common small bucket
    blocks: DataFrame  # bucket, i, lo, hi, part, id: texts of large buckets, once for each block they are compared with
    sets: DataFrame  # id, large, grams
    bands: int

    def members(self, per_copy: DataFrame | None = None) -> DataFrame:
        """doc_id, copy_id and what is known per copy.

        A large group of copies meets it through runs, so no task receives all of the group.
        """
        copies = self.copies if per_copy is None else self.copies.join(per_copy, "copy_id", "left")
        return self.rows.join(copies, ["run", "digest"]).drop("run", "digest").withColumnRenamed("id", "doc_id")

    def in_blocks(self, similarity: float, each: bool) -> DataFrame:
        """Links of the large buckets: (a, b, similarity) each, or (id, root, n_links) for a text and a pair of blocks."""
        schema = "a long, b long, similarity double" if each else "id long, root long, n_links long"
        return self.blocks.join(self.sets, "id").groupBy("bucket", "lo", "hi").applyInArrow(_block_links(similarity, self.bands, each), schema)


def candidates(
    docs: DataFrame, k: int, similarity: float, recall: float, doc_id: str, text: str, small: int = SMALL, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS
) -> Candidates:
    """Texts whose bands meet.

    A bucket of up to `small` texts gives its pairs. A larger one is cut into blocks by hash,
    bounded in texts and n-grams, and every two blocks are compared in a task that receives
    each n-gram set once; no pair is emitted before it is verified.
    """
    bands, rows = choose_bands(similarity, recall)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    signed = stored(base.mapInArrow(_signatures(k, bands, rows), "id long, digest binary, bands array<long>, size long"), "bands")
    first = signed.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "bands", "size")).alias("least"))
    reps = stored(first.select("digest", "least.id", "least.bands", "least.size"), "reps")
    known = reps.where("id IS NOT NULL")
    buckets = known.select("id", "size", F.posexplode("bands").alias("i", "bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("grams")).where("members > 1")
    met = stored(buckets.drop("size").join(sizes, "bucket"), "buckets")

    order = Window.partitionBy("bucket").orderBy("id")
    ahead = F.array_compact(F.array(*[F.lead("id", j).over(order) for j in range(1, small)]))
    beside = met.where(F.col("members") <= small).select(F.col("id").alias("a"), ahead.alias("ahead"))
    pairs = stored(beside.select("a", F.explode("ahead").alias("b")).where("a <> b").distinct(), "pairs")

    large = met.where(F.col("members") > small)
    parts = F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("grams") / block_grams))
    cut = large.select("bucket", "i", "id", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        "bucket", "i", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id"
    )
    slots = large.groupBy("id").agg(F.collect_list(F.struct("i", "bucket")).alias("large"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(slots.select("id")).distinct().join(slots, "id", "left")
    texts = base.join(known.select("id", "digest").join(wanted, "id"), ["id", "digest"]).dropDuplicates(["id"]).select("id", "large", "text")
    sets = stored(texts.mapInArrow(_sets(k), "id long, large array<struct<i:int,bucket:long>>, grams binary"), "sets")
    placed = signed.select("id", "digest", run_of(256, "id").alias("run"))
    copies = placed.select("run", "digest").distinct().join(reps.select("digest", F.col("id").alias("copy_id")), "digest")
    return Candidates(placed, copies, pairs, blocks, sets, bands)


def ngram_jaccard_links(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.999, doc_id: str = "doc_id", text: str = "text", **blocks: int
) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, copy_id; links: a, b, similarity between copy_ids, a < b.

    copy_id is the smallest id among the rows of equal lower-cased text, so copies are never
    paired with each other. Texts whose MinHash bands meet are candidates, and each candidate
    pair is verified on the full sets of n-grams.
    """
    found = candidates(docs, k, similarity, recall, doc_id, text, **blocks)
    return found.members(), verified(found.pairs, found.sets, similarity).unionByName(found.in_blocks(similarity, True))


def ngram_jaccard_join(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.999, doc_id: str = "doc_id", text: str = "text", **blocks: int
) -> DataFrame:
    """One row per document: doc_id, copy_id, class_id, n_links.

    Texts are lower-cased and cut at white space; a text of fewer than k words is one n-gram
    of all its words. Two texts are linked when the Jaccard similarity of their sets of k-word
    n-grams is at least `similarity`. copy_id is the smallest id of equal texts, class_id the
    smallest id of all texts connected by links, n_links the number of different texts that
    the text is linked to. Every two texts with a common band are compared. Large groups of
    near copies are counted where they are compared; their links are not written out.
    Null and empty texts are copies of each other and have no links. Repeated rows are each
    returned; rows with a null id get the class of their copies, null if they have none but
    null ids. Further columns are ignored; no rows give no rows.
    """
    found = candidates(docs, k, similarity, recall, doc_id, text, **blocks)
    links = stored(verified(found.pairs, found.sets, similarity).select("a", "b"), "links")
    crowds = stored(found.in_blocks(similarity, False), "crowds")
    roots = components(links.unionByName(crowds.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b")))
    one = F.lit(1).cast("long").alias("n")
    counts = (
        links.select(F.col("a").alias("id"), one)
        .unionByName(links.select(F.col("b").alias("id"), one))
        .unionByName(crowds.select("id", F.col("n_links").alias("n")))
        .groupBy("id")
        .agg(F.sum("n").alias("n_links"))
    )
    per_copy = roots.join(counts, "id").withColumnRenamed("id", "copy_id")
    return found.members(per_copy).select(
        "doc_id", "copy_id", F.coalesce("root", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
