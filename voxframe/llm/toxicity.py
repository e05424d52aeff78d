"""Toxicity: a learned lexicon met by Levenshtein automata, weighed by the words around each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from voxframe.llm.common import BROADCAST_ROWS, stored

# fixed values
WORD = re.compile(r"\w+|[\"“”„«»]")
QUOTES = frozenset('"“”„«»')
FEATURES = ["open_exact", "open_misspelled", "quoted", "best_window", "density"]

#: Most labelled rows that the classifier is fitted on, of each class; rows are taken by the hash of their text.
FIT_ROWS = 10_000
#: A term stands in at least this share of the toxic texts of the fit, and passes the likelihood-ratio test.
MIN_SHARE, MIN_G2, MIN_LOG_ODDS = 0.008, 20.0, 2.0
#: Words on either side of a hit that make up its context.
WINDOW = 12


def held_out(doc_id: Column) -> Column:
    """True for rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Automaton:
    """All words within the allowed edits of a lexicon, as one deterministic automaton."""

    classes: dict[str, int]  # of each letter that occurs in a term; 0 is any other
    step: np.ndarray  # state x class -> state; state 0 accepts nothing any more
    exact: np.ndarray  # of each state: the term read without an edit, else -1
    near: np.ndarray  # the term reached with an edit, else -1


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1


def build_automaton(terms: list[str]) -> Automaton:
    """Intersect the Levenshtein automata of all terms with the trie of the terms.

    A state is the set of (trie node, edits spent) that the letters read so far may have led
    to; only letters on edges out of that set need a transition of their own.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    spare: list[int] = [0]  # edits that some term below a node still allows
    for number, term in enumerate(terms):
        node = 0
        spare[0] = max(spare[0], edits_allowed(term))
        for letter in term:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
                spare.append(0)
            node = children[node][letter]
            spare[node] = max(spare[node], edits_allowed(term))
        ends[node] = number
    letters = sorted({c for t in terms for c in t})
    classes = {c: i + 1 for i, c in enumerate(letters)}

    def close(state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo, out = list(state), set(state)
        while todo:  # a letter of the term that the word leaves out
            node, spent = todo.pop()
            if spent < spare[node]:
                for nxt in children[node].values():
                    if spent + 1 <= spare[nxt] and (nxt, spent + 1) not in out:
                        out.add((nxt, spent + 1))
                        todo.append((nxt, spent + 1))
        # a node reached with fewer edits covers the same node with more
        return frozenset(x for x in out if not any((x[0], e) in out for e in range(x[1])))

    def read(state: frozenset[tuple[int, int]], letter: str | None) -> frozenset[tuple[int, int]]:
        out = set()
        for node, spent in state:
            if letter in children[node]:
                out.add((children[node][letter], spent))
            if spent < spare[node]:
                out.add((node, spent + 1))
                out.update((nxt, spent + 1) for c, nxt in children[node].items() if c != letter and spent + 1 <= spare[nxt])
        return close(out)

    dead: frozenset[tuple[int, int]] = frozenset()
    numbers = {dead: 0, close({(0, 0)}): 1}
    order, rows, i = list(numbers), [], 0
    while i < len(order):
        state = order[i]
        i += 1

        def number(target: frozenset[tuple[int, int]]) -> int:
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            return numbers[target]

        row = np.full(len(letters) + 1, number(read(state, None)), np.int32)
        for letter in {c for node, _ in state for c in children[node]}:
            row[classes[letter]] = number(read(state, letter))
        rows.append(row)
    exact, near = np.full(len(order), -1, np.int32), np.full(len(order), -1, np.int32)
    for s, state in enumerate(order):
        for node, spent in state:
            if ends[node] >= 0:
                if spent == 0:
                    exact[s] = ends[node]
                elif spent <= edits_allowed(terms[ends[node]]):
                    near[s] = max(near[s], ends[node])
    return Automaton(classes, np.vstack(rows), exact, near)


def match(automaton: Automaton, words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(term read exactly, term within an edit) of each word, -1 for none; all words step together."""
    exact, near = np.full(len(words), -1, np.int32), np.full(len(words), -1, np.int32)
    fits = [i for i, w in enumerate(words) if len(w) <= longest + 1]
    if not fits:
        return exact, near
    chars = np.array([words[i] for i in fits]).view(np.uint32).reshape(len(fits), -1)
    table = np.zeros(0x110000, np.uint16)
    for letter, c in automaton.classes.items():
        table[ord(letter)] = c
    state = np.ones(len(fits), np.int32)
    for column in range(chars.shape[1]):
        on = chars[:, column] > 0
        state[on] = automaton.step[state[on], table[chars[on, column]]]
    exact[fits], near[fits] = automaton.exact[state], automaton.near[state]
    return exact, near


@dataclass
class Lexicon:
    weights: dict[str, float]  # log odds of each term
    innocent: frozenset[str] = frozenset()  # spellings near a term that clean texts of the fit use

    def scorer(self):
        terms = sorted(self.weights)
        automaton = build_automaton(terms)
        weights = np.array([self.weights[t] for t in terms] or [0.0])
        longest = max(map(len, terms), default=0)

        def hits(texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, float, bool, str]]]]:
            """The words of each text and its hits: place, weight, exact, spelling."""
            split = [WORD.findall(t.lower()) for t in texts]
            known = list({w for ws in split for w in ws})
            exact, near = match(automaton, known, longest)
            found = {known[i]: (float(weights[exact[i]]), True) for i in np.flatnonzero(exact >= 0)}
            for i in np.flatnonzero((exact < 0) & (near >= 0)):
                if known[i] not in self.innocent:
                    found[known[i]] = (float(weights[near[i]]), False)
            for ws in split:
                yield ws, [(i, *found[w], w) for i, w in enumerate(ws) if w in found] if found else []

        return hits


def features(words: list[str], hits: list[tuple[int, float, bool, str]]) -> list[float]:
    """Sums over the hits of a text, each by its context: within quotation marks or open, alone or in company."""
    if not hits:
        return [0.0] * len(FEATURES)
    marks = np.cumsum([w in QUOTES for w in words])
    places = np.array([h[0] for h in hits])
    weight = np.array([h[1] * (1.0 if h[2] else 0.5) for h in hits])
    exact = np.array([h[2] for h in hits])
    # an odd number of marks before a hit and a closing one soon after it: someone is quoted
    ahead = np.minimum(places + WINDOW, len(words) - 1)
    quoted = (marks[places] % 2 == 1) & (marks[ahead] > marks[places])
    said = np.concatenate([[0.0], np.cumsum(np.where(quoted, 0.25, 1.0) * weight)])
    window = said[np.searchsorted(places, places + WINDOW, "right")] - said[np.searchsorted(places, places - WINDOW, "left")]
    return [
        float(np.log1p(weight[~quoted & exact].sum())),
        float(np.log1p(weight[~quoted & ~exact].sum())),
        float(np.log1p(weight[quoted].sum())),
        float(np.log1p(window.max())),
        float(np.log1p(100.0 * said[-1] / len(words))),
    ]


def _texts(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    row, held, size = 0, [], 0
    for i, value in enumerate(batch.column(text)):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size > limit:
            yield row, held
            row, held, size = i + 1, [], 0
    if held:
        yield row, held


def _measure(lexicon: Lexicon, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = lexicon.scorer()
        for batch in batches:
            for row, texts in _texts(batch, text):
                rows = [features(ws, found) for ws, found in hits(texts)]
                own = [batch.column(c).slice(row, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    return run


def _innocent(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = lexicon.scorer()
        seen: set[str] = set()
        for batch in batches:
            for _, texts in _texts(batch, "text"):
                for _, found in hits(texts):
                    seen.update(h[3] for h in found if not h[2])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["spelling"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and bias by Newton's method; the bias is not held down."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learn the terms and the weights from rows that are not held out.

    At most about fit_rows rows of each class are used (all of them where there are fewer),
    taken by hash, so the ids broadcast to find their texts and the features brought to the
    driver are bounded. Terms are words that stand in a share of the toxic texts and hardly
    in others, by a likelihood-ratio test over near-distinct texts (of those that share the
    smallest hash of their five-word runs one counts). Without a toxic or a clean row the
    model calls everything clean (or toxic, if all labels are).
    """
    rows = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .where(~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, min(1.0, fit_rows / n))]) if sizes else F.lit(None)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = rows.where(unit < share[F.col("y")]) if sizes else rows
    # bounded by 2 x fit_rows, up to the spread of a hash
    chosen = F.broadcast(chosen) if sizes and 2.2 * fit_rows <= BROADCAST_ROWS else chosen
    texts = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "doc_id").select("text", "y"), "labelled"
    )
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    bags = texts.select("y", words.alias("words")).where(F.size("words") > 0)
    # near copies mostly share the smallest hash of their runs of five words
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))
    sketch = F.when(F.size("words") < 5, F.xxhash64("words")).otherwise(F.array_min(runs))
    once = bags.select("y", F.array_distinct("words").alias("bag"), sketch.alias("sketch")).groupBy("sketch", "y").agg(F.min("bag").alias("words"))
    totals = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(Lexicon({}), np.array([0.0] * len(FEATURES) + [4.0 if n1 else -4.0]))
    a, b = F.col("a"), F.col("b")
    expected = (a + b) * n1 / (n1 + n0)
    g2 = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    terms = (
        once.select("y", F.explode("words").alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .where(a >= F.greatest(F.lit(2.0), F.lit(MIN_SHARE * n1)))
        .select("term", g2.alias("g2"), odds.alias("odds"))
        .where((F.col("g2") >= MIN_G2) & (F.col("odds") >= MIN_LOG_ODDS))
    )
    lexicon = Lexicon({r["term"]: r["odds"] for r in terms.collect()})
    clean = texts.where("y = 0").select("text").mapInArrow(_innocent(lexicon), "spelling string").distinct()
    lexicon = Lexicon(lexicon.weights, frozenset(r["spelling"] for r in clean.collect()))
    known = texts.mapInArrow(_measure(lexicon, "text", ["y"]), "y int, features array<double>").collect()
    x, y = np.array([r["features"] for r in known]), np.array([r["y"] for r in known], float)
    order = np.lexsort([*x.T, y])
    return Model(lexicon, fit_logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, score and predicted of every row, by its whole text; null counts as empty."""
    schema = StructType([docs.schema[c] for c in keep]).add("features", ArrayType(DoubleType()))
    measured = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_measure(model.lexicon, text, keep), schema)
    x = sum((F.col("features")[i] * float(w) for i, w in enumerate(model.weights[:-1])), F.lit(float(model.weights[-1])))
    return measured.select(*keep, (1 / (1 + F.exp(-x))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Empty and null texts have no hits and get the score of the bias. Repeated rows get equal
    scores each; a null id is never learned from and is not held out. Labels of unknown
    documents, null labels and further columns are ignored; several labels of a document
    count as toxic if one is. No documents give no rows. One scan scores all texts, without
    a shuffle.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score(named, fit(docs, labels, doc_id, text, label), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
