"""Token counts of sections: whole documents are encoded once and tokens are attributed by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.words import slices

#: Which section a token that crosses boundaries counts for.
RULES = ("first", "last", "most")


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary).

    Sections are [bounds[i], bounds[i+1]). first and last count a token for the section of its
    first or last byte, most for the one that holds most of its bytes, the earliest on a tie.
    """
    head = np.searchsorted(bounds, start, "right") - 1
    tail = np.searchsorted(bounds, end - 1, "right") - 1
    crosses = head != tail
    if rule == "first":
        return head, crosses
    if rule == "last":
        return tail, crosses
    own = head.copy()
    for t in np.flatnonzero(crosses):
        cuts = np.clip(bounds[head[t] : tail[t] + 2], start[t], end[t])
        own[t] = head[t] + int(np.argmax(np.diff(cuts)))
    return own, crosses


def _counts(path: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        coder = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column("text")
            for row, stop, data, offsets in slices(texts, 1 << 22):
                newline = data == 10
                out: list[list[np.ndarray]] = [[] for _ in range(7)]
                for i in range(row, stop):
                    raw = data[offsets[i - row] : offsets[i - row + 1]]
                    # a section is a line with its line break; an empty text is one empty section
                    bounds = np.unique(np.concatenate([[0], np.flatnonzero(newline[offsets[i - row] : offsets[i - row + 1]]) + 1, [len(raw)]]))
                    if len(bounds) == 1:
                        bounds = np.array([0, 0])
                    ids = np.array(coder.encode_ordinary(texts[i].as_py() or ""), np.int64)
                    end = np.cumsum(size[ids])
                    own, crosses = attribute(end - size[ids], end, bounds[:-1], rule)
                    n = len(bounds) - 1
                    # characters begin at every byte that continues none
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    for store, values in zip(
                        out,
                        (
                            np.full(n, i),
                            np.arange(n),
                            chars[bounds[:-1]],
                            chars[bounds[1:]],
                            np.bincount(own, minlength=n),
                            np.bincount(own[crosses], minlength=n),
                            np.full(n, len(ids)),
                        ),
                    ):
                        store.append(values)
                columns = [np.concatenate(x) for x in out]
                ids = batch.column("doc_id").take(pa.array(columns[0]))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c.astype(np.int64)) for c in columns[1:])],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "most", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens.

    Sections are the lines of a text, each with its line break. The whole text is encoded once
    (byte-level BPE, ranks in `path`, no special tokens), so counts are those of the whole: a
    document's sections add up to doc_tokens. Token spans follow from the bytes of the tokens;
    a token across a boundary (n_crossing counts them where they went) belongs to one section
    by `rule`: "first", "last" or "most" (of its bytes, the earlier section on a tie). Null
    and empty texts are one empty section without tokens. Repeated rows and null ids are
    returned as they are; further columns are ignored; no rows give no rows. One scan, no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_counts(path, pattern, rule), schema)
