"""Merkle manifest of a table: one tree per language, proofs and their check, by cogrouped superblocks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Leaves of a superblock, a power of two: what one call of a Python function holds.
SUPERBLOCK = 512

# A path has one entry a level: "L" or "R" and the sibling at that side, or "-" where a node has none.
_PATHS = "tree string, pos long, n long, block long, path array<string>, root string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and what they become in `height` rounds of pairing; a last one without partner is hashed alone."""
    out = [nodes]
    for _ in range(height):
        nodes = [_hash("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _path(levels: list[list[str]], i: int) -> list[str]:
    out = []
    for nodes in levels[:-1]:
        other = i ^ 1
        out.append("-" if other >= len(nodes) else ("L" if other < i else "R") + nodes[other])
        i >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that a node and the siblings on its way give."""
    for step in path:
        node = _hash(node if step == "-" else step[1:] + node if step[0] == "L" else node + step[1:])
    return node


def _height(n: int, size: int) -> int:
    """Rounds within a superblock of a tree of n nodes."""
    return (min(n, size) - 1).bit_length()


def _reduced(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = _levels(rows["digest"].tolist(), _height(int(rows["n"].iloc[0]), size))
        paths = [_path(levels, i) for i in range(len(rows))]
        return rows[["tree", "pos", "n", "block"]].assign(path=paths, root=levels[-1][0])

    return run


def _root(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        root = _levels(rows["digest"].tolist(), _height(int(rows["n"].iloc[0]), size))[-1][0]
        return rows[["tree", "block", "n"]].head(1).assign(root=root)

    return run


def _proved(size: int):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves, above = leaves.sort_values("pos"), outer.iloc[0]
        levels = _levels(leaves["digest"].tolist(), _height(int(leaves["n"].iloc[0]), size))
        upper, root = list(above["path"]), above["root"]
        proofs, folded = [], []
        for i, leaf in enumerate(leaves["presented"]):
            path = _path(levels, i) + upper
            proofs.append(_hash("".join(s[1:] for s in path)))
            folded.append(fold(leaf, path))
        return pd.DataFrame(
            {
                "doc_id": leaves["doc_id"],
                "leaf": leaves["digest"],
                "subroot": above["subroot"],
                "root": root,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [x == root for x in folded],
            }
        )

    return run


def leaf(*values: Column) -> Column:
    """Digest of a row: each value with its length in bytes, null as a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `pos`, the place of a row in its `tree` by `order`, and `n`, the rows of the tree.

    Rows are dealt by range over (tree, order), so a tree of any size lies over many tasks;
    only one row per tree and task is summed up to find where each task's stretch begins.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged").withColumn("part", F.shiftright("at", 33))
    tree, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    heads = heads.select("tree", "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n"))
    return ranged.join(heads, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "first", "before", "at")


def climb(nodes: DataFrame, most: int, size: int) -> DataFrame:
    """(tree, pos, path, top) of nodes (tree, pos, n, digest): the way of each to the top of its tree of at most `most` nodes.

    Each round reduces superblocks of `size` nodes and goes on with their roots, so there are
    log(most) / log(size) rounds.
    """
    if most <= 1:
        return nodes.select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    blocks = nodes.select("tree", "pos", "n", "digest", F.floor(F.col("pos") / size).alias("block"))
    inner = stored(blocks.groupBy("tree", "block").applyInPandas(_reduced(size), _PATHS), "nodes")
    tops = inner.where(F.col("pos") == F.col("block") * size)
    tops = tops.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))
    upper = climb(tops, -(-most // size), size).select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), "top")
    return inner.join(upper, ["tree", "block"]).select("tree", "pos", F.concat("path", "upper").alias("path"), "top")


def merkle_manifest(docs: DataFrame, presented: str | None = None, size: int = SUPERBLOCK) -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its language), root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Per language leaves ascend
    by doc_id (null first, ties by leaf) and are paired level by level up to the subroot;
    subroots, by language (null first), are paired up to the root in the same way. The proof
    of a leaf is made of the siblings on its way. `folded_root` is what these siblings give
    with the leaf of the row as presented, which has the column named by `presented` in place
    of n_chars; `verified` says that it is the root.

    Rows that repeat another are leaves of their own. Null columns are written as a dash.
    Further columns are ignored. No rows give no rows.

    Leaves are numbered by a range sort and cut into superblocks. A first pass finds the roots
    of the superblocks, rounds over these find the nodes outside that each superblock needs,
    and leaves and outer nodes meet by superblock in a cogroup that reduces, proves and folds.
    No task holds more than `size` leaves at once, however large a language is.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    own = [F.col(c) for c in FIELDS]
    shown = F.col(presented or "n_chars")
    digest = leaf(*own)
    leaves = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        digest.alias("digest"),
        F.when(shown.eqNullSafe(F.col("n_chars")), digest).otherwise(leaf(*(shown if c == "n_chars" else F.col(c) for c in FIELDS))).alias("presented"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = numbered(stored(leaves, "leaves"), ["doc_id", "digest", "tie"]).drop("tie")
    leaves = stored(leaves.withColumn("block", F.floor(F.col("pos") / size)), "placed")

    roots = leaves.select("tree", "pos", "n", "block", "digest").groupBy("tree", "block").applyInPandas(_root(size), "tree string, block long, n long, root string")
    roots = stored(roots, "roots").select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))
    most, trees = roots.agg(F.max("n"), F.count(F.when(F.col("pos") == 0, 1))).first()
    outer = stored(climb(roots, most or 0, size), "outer")

    subroots = outer.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    named = stored(numbered(subroots, ["name"]), "subroots")
    last = climb(named, trees, size).join(named, ["tree", "pos"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper"), F.col("top").alias("root"))
    outer = outer.join(last, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "upper").alias("path"), "subroot", "root")

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    leaves = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null integers
    proved = leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_proved(size), schema)
    return proved.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
