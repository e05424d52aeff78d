"""Words that differ by one letter, by Gram matrices of letter counts over blocks that share half a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import stored

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO, DELETE_ONE_IN = 7, 2, 10, 31

#: Words and letters of a block; a larger bucket is cut into blocks that meet two by two.
BLOCK_WORDS, BLOCK_LETTERS = 1024, 1 << 18
#: Rows of small buckets that share one product.
SLAB = 384
#: Letters are counted by code point modulo this: letters that fall together only bring a pair more to verify.
DIMENSIONS = 32


def _cut(run: Column, h: Column) -> Column:
    """Delete one code point of one run in 31, as its hash says."""
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(DELETE_ONE_IN)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): letter runs with A-Z lower-cased and one letter deleted where crc32 of id and run says so."""
    runs = docs.select(
        F.col(doc_id).cast("string").alias("doc"),
        F.explode(F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= LEAST_LETTERS)
    word = _cut(F.col("run"), F.coalesce(F.crc32(F.concat("doc", F.lit(":"), "run")), F.lit(1)))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def halves(words: DataFrame) -> DataFrame:
    """Four rows a word: as the shorter and as the longer of a pair, under its first and under its last half.

    A pair whose shorter word has `base` letters differs by one edit, so it agrees in the first
    base // 2 letters or in the last base - base // 2.
    """
    length = F.char_length("word")
    keys = []
    for base in (length, length - 1):
        half = F.floor(base / 2).cast("int")
        keys += [F.struct(F.lit(side).alias("side"), base.alias("base"), part.alias("part")) for side, part in ((0, F.substring("word", F.lit(1), half)), (1, F.substring("word", length - (base - half) + 1, base - half)))]
    rows = words.select("word", "n", F.explode(F.array(*keys)).alias("k"))
    return rows.select("word", "n", F.xxhash64("k.side", "k.base", "k.part").alias("bucket"), "k.side", "k.base")


class _Slab:
    """Rows of whole groups, compared by one product of letter counts."""

    def __init__(self, rows: list[tuple], groups: np.ndarray):
        self.words = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], np.int64)
        self.base = np.array([r[2] for r in rows], np.int64)
        self.side = np.array([r[3] for r in rows], np.int8)
        self.block = np.array([r[4] for r in rows], np.int64)
        self.across = np.array([r[5] != r[6] for r in rows], bool)
        self.group = groups
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.codes = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32).astype(np.int32)
        self.first = np.cumsum(self.length) - self.length

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a group at a squared distance of at most two, in lengths that one edit allows."""
        m = len(self.words)
        at = np.repeat(np.arange(m), self.length) * DIMENSIONS + self.codes % DIMENSIONS
        counts = np.bincount(at, minlength=m * DIMENSIONS).reshape(m, DIMENSIONS)
        counts = counts.astype(np.float64 if counts.max() > 1000 else np.float32)  # sums stay exact
        square = (counts * counts).sum(1)
        near = square[:, None] + square[None, :] - 2 * (counts @ counts.T) <= 2
        near &= self.group[:, None] == self.group[None, :]
        longer = self.length > self.base
        near &= ~(longer[:, None] & longer[None, :])
        a, b = np.nonzero(np.triu(near, 1))
        keep = ~self.across[a] | (self.block[a] != self.block[b])
        return a[keep], b[keep]

    def aligned(self, width: int, right: bool) -> np.ndarray:
        out = np.zeros((len(self.words), width), np.int32)
        row = np.repeat(np.arange(len(self.words)), self.length)
        place = np.arange(len(self.codes)) - np.repeat(self.first, self.length)
        out[row, place + (np.repeat(width - self.length, self.length) if right else 0)] = self.codes
        return out

    def verified(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that differ by one edit; a pair that also agrees in the first half is left to that bucket."""
        a, b = self.candidates()
        if not len(a):
            return a, b
        width = int(self.length.max())
        left, right = self.aligned(width, False), self.aligned(width, True)
        keep = np.zeros(len(a), bool)
        step = max(1, (1 << 22) // width)
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            short, long = np.minimum(self.length[x], self.length[y]), np.maximum(self.length[x], self.length[y])
            lead, tail = left[x] != left[y], (right[x] != right[y])[:, ::-1]
            lead = np.minimum(np.where(lead.any(1), lead.argmax(1), width), short)
            tail = np.minimum(np.where(tail.any(1), tail.argmax(1), width), short)
            one = np.where(short == long, lead + tail == short - 1, lead + tail >= short)
            keep[i : i + step] = one & ((self.side[x] == 0) | (lead < self.base[x] // 2))
        return a[keep], b[keep]

    def found(self) -> Iterator[tuple]:
        """(word, near words, n and word of the best of them) of each row that has some."""
        a, b = self.verified()
        if not len(a):
            return
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[b], -self.n[b], a))
        a, b = a[order], b[order]
        rows, first, count = np.unique(a, return_index=True, return_counts=True)
        for i, j, k in zip(rows, b[first], count, strict=True):
            yield self.words[i], int(k), int(self.n[j]), self.words[j]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and block pair; whole groups are put together into slabs."""
    names = ["word", "near", "best_n", "best_word"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def results(rows: list[tuple], groups: list[int]) -> pa.RecordBatch:
        out = list(_Slab(rows, np.array(groups)).found())
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    done: list[tuple] = []
    groups: list[int] = []
    own: list[tuple] = []
    last, number = None, 0
    for batch in batches:
        bucket, lo, hi, *rest = (c.to_pylist() for c in batch.columns)
        for key, row in zip(zip(bucket, lo, hi, strict=True), zip(*rest, lo, hi, strict=True), strict=True):
            if key != last:
                if len(own) > 1:
                    done += own
                    groups += [number] * len(own)
                    number += 1
                own, last = [], key
                if len(done) >= SLAB:
                    yield results(done, groups)
                    done, groups = [], []
            own.append(row)
    if len(own) > 1:
        done += own
        groups += [number] * len(own)
    if done:
        yield results(done, groups)


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best_word) of words (word, n) that have a near one: one letter inserted, deleted or replaced.

    A bucket holds the words of two neighbouring lengths that agree in one half. Buckets over
    the size of a block are cut into blocks by hash; every two blocks meet in a group of their
    own, so no group outgrows its bound and no pair is lost. Each near pair is found in one
    bucket. Groups hand back a count and the best word of each row, never pairs.
    """
    keyed = stored(halves(words), "halves")
    size = keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("word")).alias("letters"), F.min(F.char_length("word") - F.col("base")).alias("least")
    )
    size = size.where("rows > 1 AND least = 0").select("bucket", F.greatest(F.ceil(F.col("rows") / block_words), F.ceil(F.col("letters") / block_letters)).cast("int").alias("blocks"))
    rows = keyed.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "word", "n", "base", "side", "block")
    found = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_compare, "word string, near long, best_n long, best_word string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best_word")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best_word").alias("best_word"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have at least 7 letters and 2 occurrences. The form of a word is its near word of
    largest n (ties: first in code-point order) if that is ten times as frequent, else null;
    the root is where forms lead. Null and empty texts have no words; repeated rows count
    again; a row without an id deletes no letters; no rows give no rows; further columns are
    ignored.

    Occurrences are counted before anything else is shuffled, so frequent words are one row.
    Forms are ten times as frequent at each step, so the number of pointer jumps follows from
    the largest count.
    """
    words = stored(vocabulary(docs, doc_id, text), "vocabulary")
    near = near_words(words, block_words, block_letters)
    form = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best_word"))
    table = words.join(near, "word", "left").withColumn("form", form)
    table = stored(table.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "forms")

    most = words.agg(F.max("n")).first()[0] or 0
    hops, n = 0, LEAST_COUNT * RATIO
    while n <= most:
        hops, n = hops + 1, n * RATIO
    links = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range((hops - 1).bit_length() if hops > 1 else 0):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "links")
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
