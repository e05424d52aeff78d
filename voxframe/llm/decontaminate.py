"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import stored

# fixed values: the word rule of the contract, and the letters that are lowered
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows that one broadcast may hold; a larger benchmark is joined in several such blocks.
BLOCK_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    """Words in order. A null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """(window, items): distinct windows of `size` words, or the whole of a shorter item, with the items that hold them."""
    words = F.col("words")
    start = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1))
    return (
        benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
        .where(F.size("words") > 0)
        .select("item", F.explode(F.transform(start, lambda s: F.slice(words, s, size))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def prefixes(grams: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(token, at, window, items): each window under its rarest word, and where in the window that word stands.

    Containment of a whole window needs every one of its words, so under one order of all
    words a prefix of one token is enough. The order is by number of uses in the documents
    (counted over all of them, for the words that the benchmark has), then by the word.
    """
    vocabulary = grams.select(F.explode("window").alias("token")).distinct()
    uses = (
        docs.select(F.explode(words_of(F.col(text))).alias("token"))
        .join(F.broadcast(vocabulary) if vocabulary.limit(BLOCK_WINDOWS + 1).count() <= BLOCK_WINDOWS else vocabulary, "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    token = F.struct(F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), F.col("token"), F.col("at"))
    return (
        grams.select("window", "items", F.posexplode("window").alias("at", "token"))
        .join(uses, "token", "left")
        .groupBy("window", "items")
        .agg(F.min(token).alias("rarest"))
        .select("rarest.token", "rarest.at", "window", "items")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    share: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    A word inside an occurrence of a benchmark window is hit; a document is contaminated when
    it has hit words and they are at least 1/share of its words. Null and empty texts have no
    words and are clean; items without words have no windows. Rows that repeat id and text are
    each returned, with equal figures (text_hash, xxhash64 of the text, tells rows of one id apart); a null id is returned as it is. Further columns are ignored.

    Each document is scanned once per block of windows (one block unless the benchmark is
    large): its words meet the windows' rarest words in a broadcast hash join, positions that
    leave no room for the window are dropped, and what is left is compared word by word. Only
    verified occurrences and one summary row per document are shuffled.
    """
    grams = stored(windows(benchmark, size, item_id, item_text), "windows")
    keyed = stored(prefixes(grams, docs, text), "prefixes")
    blocks = max(1, -(-keyed.count() // block_windows))
    # the text's hash keeps rows apart that share an id or have none
    words = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        words_of(F.col(text)).alias("words"),
    )
    n = F.size("words")
    # a last element past the end stands for the document itself and meets no window
    placed = words.select("*", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "token"))
    start = F.col("pos") - F.col("at")

    def block(b: int) -> DataFrame:
        part = F.broadcast(keyed.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b))
        self_row = F.col("token").isNull()
        return (
            placed.join(part, "token", "left")
            .where(
                self_row
                | (
                    F.col("at").isNotNull()
                    & (start >= 0)
                    & (start + F.size("window") <= n)
                    & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
                )
            )
            .select(
                "doc_id",
                "text_hash",
                F.when(self_row, n).alias("n_words"),
                F.when(~self_row, F.struct(start.alias("start"), (start + F.size("window")).alias("end"))).alias("span"),
                F.when(~self_row, F.col("items")).alias("items"),
            )
        )

    found = reduce(DataFrame.unionByName, [block(b) for b in range(blocks)])
    per_doc = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        (F.count("n_words") / blocks).cast("int").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # spans in order of start: a span adds what reaches beyond the end so far
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"),
        ),
    )["n"]
    return (
        per_doc.select(
            "doc_id",
            "n_words",
            covered.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            "text_hash",
            "copies",
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
        .select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copies", "copy")
    )
