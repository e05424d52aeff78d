"""Edit distance of word sequences, 4,096 cells of the table at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BITS = 4096


def distance(a: Sequence[str], b: Sequence[str], bits: int = BITS) -> int:
    """Insertions, deletions and replacements that make one sequence the other.

    A column of the table is held as two bit vectors of its steps up and down, and a whole
    column is found from the one before it by a few operations on integers. Long sequences are
    taken in stretches of `bits` rows, each handing its last row's steps to the next, so memory
    grows with the length and not with the table.
    """
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    steps = [1] * len(b)
    for start in range(0, len(a), bits):
        rows = a[start : start + bits]
        full, top = (1 << len(rows)) - 1, 1 << (len(rows) - 1)
        places: dict[str, int] = {}
        for i, word in enumerate(rows):
            places[word] = places.get(word, 0) | 1 << i
        up, down = full, 0
        for j, word in enumerate(b):
            into, same = steps[j], places.get(word, 0)
            changed = same | down
            if into < 0:
                same |= 1
            across = (((same & up) + up) ^ up) | same
            rise, fall = down | (full & ~(across | up)), up & across
            steps[j] = 1 if rise & top else -1 if fall & top else 0
            rise, fall = rise << 1 | (into > 0), fall << 1 | (into < 0)
            up, down = (fall | ~(changed | rise)) & full, rise & changed & full
    return len(a) + sum(steps) if len(a) else len(b)


@F.pandas_udf(LongType())
def _distances(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else distance(a.split(" "), b.split(" ")) if a and b else a.count(" ") + b.count(" ") + (a != b) for a, b in zip(left, right)], dtype="Int64")


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two arrays of words without spaces; null if one of them is."""
    return _distances(F.array_join(reference, " "), F.array_join(hypothesis, " "))
