"""Operators of the training-data subpackage: brute force, round trips and edge cases."""

import base64
import glob
import gzip
import hashlib
import itertools
import os
import random
import struct
import subprocess
import sys
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from voxframe.llm import byte_bpe, decontaminate, exact_dedup, html_text, near_join, substring_dedup, suffix_dedup, token_counts, toxicity, warc
from voxframe.llm.common import read_table
from voxframe.llm.fm_index import FMIndex
from voxframe.llm.words import words

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGE = [
    (1, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (None, "one two three four five six seven"),
    (None, None),
    (6, LONG),
    (7, LONG + " end"),
    (8, "naïve Ünïcode 文字 \U0001f600 text"),
    (9, "same id"),
    (9, "same id, other text"),
]


def frame(spark, rows, schema="doc_id long, text string"):
    """The rows with columns whose names the operators use inside."""
    extra = "run digest bands features route words spans score ids id key bucket tie doc html cut item token pos predicted stay_id stay_digest row_digest gone_id gone_hash copies span block base host".split()
    own = spark.createDataFrame(rows, schema)
    return own.withColumns({c: F.lit(i) for i, c in enumerate(extra) if c not in own.columns})


def corpus(seed, n=150):
    """Texts with copies, near copies, shared passages and repeated stretches."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, out = make(70), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            own = make(rng.randrange(0, 120))
        elif kind == 1:
            own = list(rng.choice(out))
        elif kind == 2:
            own = list(rng.choice(out))
            for _ in range(2):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
        elif kind == 3:
            own = make(rng.randrange(5, 40)) + passage[rng.randrange(20) :] + make(10)
        elif kind == 4:
            own = make(7) * rng.randrange(1, 12)
        else:
            own = make(30)
            own = own + make(3) + own
        out.append(own)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_exact_dedup_edges(spark):
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(frame(spark, EDGE), keep=keep, runs=4, ways=2).collect()
        assert len(got) == len(EDGE)
        groups = {}
        for i, t in EDGE:
            groups.setdefault(t or "", []).append(i)
        for r in got:
            ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            known = [i for i in ids if i is not None]
            assert r.group_size == len(ids) and r.keep_id == best(known, default=None)
            assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_dedup(frame(spark, EDGE[:0])).count() == 0


def brute_window_hits(text, items, size=13):
    cut = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", cut(t)) if w]
    own, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        k = min(size, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            for p in range(len(own) - k + 1):
                if own[p : p + k] == w[s : s + k]:
                    hit.update(range(p, p + k))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(10, "Alpha beta GAMMA"), (9, " ".join(rng.choice("abcdefgh") for _ in range(30))), (11, None), (12, "!!"), (100, "solo"), (13, " ".join(f"q{i}" for i in range(20)))]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20)) + " " + items[1][1][2:40] + " x alpha-Beta, gamma") for i in range(20)]
    rows += [(50, "Solo É solo"), (51, None), (52, ""), (None, "solo"), (53, items[5][1] * 2), (53, items[5][1] * 2), (54, "q0 " * 50_000), (55, "ALPHA BETA"), (55, "alpha beta gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (100_000, 3):
        got = decontaminate.decontaminate(frame(spark, rows), bench, block_windows=block).collect()
        want = sorted(((i, *brute_window_hits(t, items)) for i, t in rows), key=str)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == want
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark, rows[:0]), bench).count() == 0


def shingles(text, k=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_classes(rows, similarity=0.8):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t or "") for i, t in rows}
    texts = {i: (t or "").lower() for i, t in rows}
    for a, b in itertools.combinations(sorted(root), 2):
        both = len(sets[a] & sets[b])
        if texts[a] == texts[b] or (both and both >= similarity * (len(sets[a]) + len(sets[b]) - both)):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


def test_bands_reach_the_recall():
    bands, rows = near_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        near_join.choose_bands(0.2, 0.999999, 4)


@pytest.mark.parametrize("blocks", [{}, {"small": 3, "block_rows": 7}, {"small": 2, "block_grams": 900}, {"small": 1000}])
def test_near_join(spark, blocks):
    """Links, their numbers and classes equal brute force, however buckets are cut."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = corpus(1)
    for i in range(60):  # a group of near copies, most but not all of which are linked with each other
        own = list(base)
        for _ in range(1 + i % 3):
            own[rng.randrange(120)] = f"n{i}"
        rows.append((1000 + i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    first = {}
    for i, t in rows:
        first.setdefault(t.lower(), i)
    want = {
        (a, b)
        for a, b in itertools.combinations(sorted(first.values()), 2)
        if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert 100 < len(want & set(itertools.combinations(range(1000, 1060), 2))) < 60 * 59 // 2
    _, links = near_join.ngram_jaccard_links(frame(spark, rows), recall=0.999999, **blocks)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    got = near_join.ngram_jaccard_join(frame(spark, rows), recall=0.999999, **blocks).collect()
    assert {r.doc_id: r.class_id for r in got} == jaccard_classes(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: sum(first[t.lower()] in p for p in want) for i, t in rows}


def test_near_join_edges(spark):
    got = near_join.ngram_jaccard_join(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == {3} and by[6] == by[7] == {6} and by[None] == {1, 3}
    assert near_join.ngram_jaccard_join(frame(spark, EDGE[:0])).count() == 0


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = EDGE + [(20, "a" * 500), (21, "<|endoftext|> \r\n\n  x"), (22, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000)))]
    for r in byte_bpe.byte_bpe(frame(spark, rows), RANKS, PATTERN).collect():
        text = bytes(r.decoded).decode()
        assert (r.doc_id, text) in [(i, t or "") for i, t in rows]
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text)
    coded = byte_bpe.byte_bpe(frame(spark, rows), RANKS, PATTERN)
    assert coded.count() == len(rows)
    again = byte_bpe.decode(coded, RANKS).groupBy("decoded").count().collect()
    assert {(bytes(r.decoded).decode(), r["count"]) for r in again} == {(t, sum((x or "") == t for _, x in rows)) for t in {x or "" for _, x in rows}}
    assert byte_bpe.byte_bpe(frame(spark, rows[:0]), RANKS, PATTERN).count() == 0


def test_merge_replay_takes_the_leftmost_lowest_rank():
    """A vocabulary whose tokens can also come about in an order other than that of their ranks."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"aab", b"ab", b"aa", b"abc", b"caab"]
    merges = {t: i for i, t in enumerate(tokens)}
    path = f"/tmp/ranks-{uuid.uuid4().hex}"
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(t) + b" %d\n" % i for t, i in merges.items())
    table = byte_bpe.read_merges(path)
    own = tiktoken.Encoding("own", pat_str=r"[a-c]+", mergeable_ranks=merges, special_tokens={})
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    data = np.frombuffer("".join(pieces).encode(), np.uint8)
    ids, first = byte_bpe.replay(data, np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), table)
    assert [ids[first[i] : first[i + 1]].tolist() for i in range(len(pieces))] == [own.encode_ordinary(p) for p in pieces]


def test_toxicity_learns_and_leaves_held_out_rows(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    right = got.where("predicted = toxic").count() / got.count()
    assert right > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = frame(spark, [(i, f"good text number {i} of the {i * 7} we have read " + ("vile " * 2 if i % 3 == 0 else "")) for i in range(300)])
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    true = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    flipped = true.withColumn("toxic", F.when(F.col("doc_id").isin(*held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (true, flipped))
    assert a == b and all((s >= 0.5) == (i % 3 == 0) for i, s in a)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (77, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, EDGE), labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len(toxicity.toxicity(frame(spark, EDGE), labels.limit(0)).where("predicted = 0").collect()) == len(EDGE)
    assert toxicity.toxicity(frame(spark, EDGE[:0]), labels).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_accepts_what_is_within_the_allowed_edits():
    terms = ["moron", "morons", "scum", "stupid", "cat"]
    machine = toxicity.build_automaton(terms)
    rng = random.Random(4)
    tried = {"", "moron", "m0ron", "mornos", "scvm", "stupiid", "xcat"}
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "x", "o", "s"])
        tried.add("".join(w))
    tried = sorted(tried - {""})
    exact, near = toxicity.match(machine, tried, 6)
    for w, e, n in zip(tried, exact, near):
        assert (e >= 0) == (w in terms)
        if w not in terms:
            assert (n >= 0) == any(distance(w, t) <= toxicity.edits_allowed(t) for t in terms), w


def test_quotation_weighs_less_than_abuse():
    hits = toxicity.Lexicon({"moron": 3.0}).scorer()
    score = lambda t: sum(toxicity.features(*next(iter(hits([t])))))
    assert score("you moron go away now") > score("they called me a “ moron ” and I wrote it down") > score("a fine day") == 0
    assert score("you mor0n go away now") > 0


def test_token_counts(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in EDGE if r[0] not in (2, 9, None)] + [(30, "a\n\n\nb  \n  c é\n"), (31, "\n"), (32, "x\r\ny")]
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.token_counts(frame(spark, rows), RANKS, PATTERN, rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            parts = sorted(got[i], key=lambda r: r.section)
            assert sum(r.n_tokens for r in parts) == parts[0].doc_tokens == len(own.encode_ordinary(t or ""))
            assert [(t or "")[r.start_char : r.end_char] for r in parts] == ((t or "").splitlines(keepends=True) if "\r" not in (t or "") else ["x\r\n", "y"]) or not t
    with pytest.raises(ValueError):
        token_counts.token_counts(frame(spark, rows), RANKS, PATTERN, "none")
    bounds = np.array([0, 4, 6])
    start, end = np.array([0, 3, 2, 5]), np.array([3, 5, 7, 6])
    assert token_counts.attribute(start, end, bounds, "first")[0].tolist() == [0, 0, 0, 1]
    assert token_counts.attribute(start, end, np.append(bounds, 9), "last")[0].tolist()[:2] == [0, 1]
    assert token_counts.attribute(start, end, np.append(bounds, 9), "most")[0].tolist() == [0, 0, 0, 1]


def sections_by_hand(text, coder, rule):
    """(tokens, crossing tokens) of each line, token by token and byte by byte."""
    lines = [x.encode() for x in (text or "").split("\n")]
    lines = [x + b"\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]
    section = [i for i, x in enumerate(lines) for _ in x]
    tokens, crossing, at = [0] * max(len(lines), 1), [0] * max(len(lines), 1), 0
    for token in coder.encode_ordinary(text or ""):
        held = section[at : at + len(coder.decode_single_token_bytes(token))]
        at += len(held)
        own = held[0] if rule == "first" else held[-1] if rule == "last" else min(set(held), key=lambda i: (-held.count(i), i))
        tokens[own] += 1
        crossing[own] += held[0] != held[-1]
    return list(zip(tokens, crossing))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_token_by_token(spark, rule):
    """Every document, null ids and repeated rows too; no rows give no rows."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [r for r in EDGE if r[0] not in (6, 7)] + [(40, "a\n\n\n\nb  \n\n  c é\n\n"), (41, "\n\n\n"), (42, "é\n文字\n\n\n\U0001f600")] * 2
    got = token_counts.token_counts(frame(spark, rows), RANKS, PATTERN, rule).collect()
    want = [(i, n, *pair) for i, text in rows for n, pair in enumerate(sections_by_hand(text, coder, rule))]
    assert sorted(((r.doc_id, r.section, r.n_tokens, r.n_crossing) for r in got), key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 5
    assert token_counts.token_counts(frame(spark, []), RANKS, PATTERN, rule).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, k), 0) for k in (30, 1, 50, 80)])
    index = FMIndex(text, 6)
    ends = np.array([e for e in range(6, len(text)) if 0 not in text[e - 6 : e]])
    low, high = index.search(text, ends, 6)
    for e, a, b in zip(ends, low, high):
        places = [p for p in range(len(text) - 5) if (text[p : p + 6] == text[e - 6 : e]).all()]
        assert (b - a if b > a else 1) == len(places)
        assert b <= a or sorted(index.suffixes[a:b]) == places


def kept_words(rows, window=20):
    """By brute force; a null id comes last, texts under one id are told apart by place."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w, gone = (t or "").encode().split(), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append((i, len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_substring_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "ROUTE_SEGMENTS", crowd)
    rows = corpus(2) + [(900, LONG), (901, None), (902, ""), (903, LONG), (904, "ä " * 300)]
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == kept_words(rows)


def test_substring_dedup_deals_out_a_hot_passage(spark, monkeypatch):
    """A passage with other surroundings in each document: no group of rows holds all of them, and the result is whole."""
    monkeypatch.setattr(substring_dedup, "ROUTE_SEGMENTS", 20)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    word = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(word(25) + passage + word(25))) for i in range(400)]
    groups, cut = [], substring_dedup._cut(20)
    batch = pa.RecordBatch.from_pylist([{"doc": i, "tie": 0, "text": t, "wanted": [{"start": 0, "n": 80, "route": 1, "salts": 20}]} for i, t in rows])
    for out in cut(iter([batch])):
        groups += zip(out.column("route").to_pylist(), out.column("salt").to_pylist())
    assert max(Counter(groups).values()) < 60
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == kept_words(rows)


def test_substring_dedup_edges(spark):
    rows = [(1, "a " * 30 + "b"), (1, "a " * 30 + "b"), (None, "a " * 30), (2, "c " * 5)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 31, 30), (1, 31, 30), (None, 30, 30), (2, 5, 0)], key=str) or got == sorted([(1, 31, 29), (1, 31, 29), (None, 30, 30), (2, 5, 0)], key=str)
    assert substring_dedup.substring_dedup(frame(spark, rows[:0])).count() == 0


def test_suffix_dedup(spark):
    rows = corpus(3) + [(900, LONG), (901, None), (902, ""), (903, LONG[:200_000])]
    got = {}
    for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect():
        assert r.end_word - r.start_word == r.n_words >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    places = {}
    for i, t in rows:
        w = (t or "").split()
        for s in range(len(w) - 49):
            places.setdefault(hash(tuple(w[s : s + 50])), []).append((i, s))
    want = {}
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                want.setdefault(i, set()).update(range(s, s + 50))
    assert set(got) == set(want)
    assert all(got[i] <= want[i] for i in got)
    assert sum(map(len, got.values())) >= 0.999 * sum(map(len, want.values()))
    assert suffix_dedup.suffix_dedup(frame(spark, EDGE)).where("n_words < 50").count() == 0
    assert suffix_dedup.suffix_dedup(frame(spark, EDGE[:0])).count() == 0


def repeated_words(rows, window=50):
    """By brute force: of each document the words in windows that also stand elsewhere."""
    places, out = {}, {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - window + 1):
            places.setdefault(tuple(w[s : s + window]), []).append((i, s))
    for i, s in (x for found in places.values() if len(found) > 1 for x in found):
        out.setdefault(i, set()).update(range(s, s + window))
    return out


@pytest.mark.parametrize("rows_at_a_time", [20_000, 8])
def test_suffix_dedup_finds_what_neighbours_miss(spark, monkeypatch, rows_at_a_time):
    """Passages whose partner is no neighbour, since many others share either half, and overlapping repeats with different partners."""
    monkeypatch.setattr(suffix_dedup, "SORT_ROWS", rows_at_a_time)
    rng, rows = random.Random(11), []
    word = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(12):
        p, q, r = word(17), word(17), word(17)
        parts = [[p, q] if k % 2 else [q, r] for k in range(60)] + [[p, q, r]] * 2
        rows += [(len(rows) + i, " ".join(sum([word(40), *x, word(40)], []))) for i, x in enumerate(parts)]
        long = word(80)
        rows += [(len(rows) + i, " ".join(word(30) + long[a:b] + word(30))) for i, (a, b) in enumerate([(0, 80), (0, 59), (22, 77), (25, 80)])]
    got = {}
    for x in suffix_dedup.suffix_dedup(frame(spark, rows)).collect():
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
        assert x.other_id is not None and (x.other_id, x.other_start) != (x.doc_id, x.start_word)
    assert got == repeated_words(rows)


def test_words_end_at_texts_and_spaces():
    texts = [b"a b", b"", b"\xc3\xa4\tc ", b"d"]
    w = words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert w.counts.tolist() == [2, 0, 2, 1]
    assert [bytes(w.data[s:e]) for s, e in zip(w.start, w.end)] == [x for t in texts for x in t.split()]


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><a>menu</a></nav>'
    '<div class="cookie-notice">we use cookies</div><article><h1>Head&amp;line {0}</h1><p><b>bold {0}<br>x</b> more\n text<p>unclosed &eacute; {0}'
    '<ul><li>item<li>other</ul><div class="sidebar"><p>side</p></div><div>Same everywhere</div><script>var a="</p><p>no";</script>'
    '<form><p>form</p></form><section id="comments"><p>reader</p></section></article><aside>aside</aside><footer>foot</footer></body></html>'
)


def test_html_extraction(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{0}", str(i))) for i in range(40)]
    rows += [(100, "https://other/1", PAGE.replace("{0}", "z")), (101, None, None), (102, "x", ""), (103, "y", "<p>cut <b>off"), (104, "", "plain &lt;text&gt;"), (104, "", "plain &lt;text&gt;"), (None, "u", "<div>" * 3000 + "deep")]
    got = html_text.html_extraction(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    # nothing of the article is cut because other pages have it too
    assert by[3].text == "Head&line 3\n\nbold 3 x more text\n\nunclosed é 3\n\nitem\n\nother\n\nSame everywhere"
    assert by[100].text == "Head&line z\n\nbold z x more text\n\nunclosed é z\n\nitem\n\nother\n\nSame everywhere"
    assert [by[i].text for i in (101, 102, 103, 104, None)] == ["", "", "cut off", "plain <text>", "deep"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.html_extraction(frame(spark, rows[:0], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("m", [8, 1_000])
def test_html_article_keeps_what_many_pages_share(spark, m):
    """The article's text stays however many pages repeat it, whatever the size of the host."""
    rows = []
    for i in range(m):
        shared = "".join(f"<{t}>shared {t}</{t}>" for t in ("p", "h2", "blockquote"))
        some = "<ul><li>on all</ul><div>note on all</div>"
        rows.append((i, f"http://h/{i}", f"<body><article>{shared}<p>own {i}</p>{some}</article></body>"))
        rows.append((m + i, f"http://plain/{i}", f"<body><div>own {i}</div><section>{'quoted' if i % 3 == 0 else i}</section><b>all pages</b></body>"))
    got = {r.page_id: r.text for r in html_text.html_extraction(frame(spark, rows, "page_id long, url string, html string")).collect()}
    for i in range(m):
        more = ["on all", "note on all"]
        assert got[i].split("\n\n") == ["shared p", "shared h2", "shared blockquote", f"own {i}", *more]
        assert got[m + i].split("\n\n") == [f"own {i}", "quoted" if i % 3 == 0 else str(i)]


def test_html_names_do_not_drop_the_article():
    story = "<h1>Title</h1><p>the whole story, told at some length</p><div class='related'><article>teaser</article></div>"
    text = lambda source: [b[1] for b in html_text.Page(source).main()]
    want = ["Title", "the whole story, told at some length"]
    for name in ("layout has-sidebar", "no-sidebar", "elementor-widget elementor-widget-text-editor", "widget", "page-header", "social share"):
        assert text(f"<body><div class='menu'>menu</div><div class='{name}'><div>x<article>{story}</article></div></div></body>") == want
        assert text(f"<body><div class='{name}'><div role='main'>{story}</div></div><div class='sidebar'>side</div></body>") == want
    # without a marked article names count for less than their absence, but more than nothing
    assert text("<div class='elementor-widget elementor-widget-text-editor'><p>story</p></div><nav>nav</nav>") == ["story"]
    assert text("<div class='no-sidebar'><p>story</p></div><div class='sidebar'>side</div>") == ["story"]
    # comments are no article where a longer text stands outside them
    assert text("<div><p>a longer story</p></div><div class='comments'><article>reply</article></div>") == ["a longer story"]
    assert text("<article><p>story</p><section id='comments'><article>reply</article></section></article>") == ["story"]


def test_html_article_keeps_what_only_sounds_like_boilerplate():
    text = lambda source: [b[1] for b in html_text.Page(source).main()]
    inside = lambda source: text(f"<article><p>first</p>{source}<p>last</p></article>")[1:-1]
    for kept in (
        '<h2 id="related-work">kept</h2>', '<section id="social-history"><p>kept</p></section>', '<table class="share-prices"><tr><td>kept</table>',
        '<p class="search-and-rescue">kept</p>', '<p class="notice">kept</p>', '<div class="comment-on-the-text">kept</div>', '<section><article>kept</article></section>',
    ):
        assert inside(kept) == ["kept"], kept
    assert inside('<p>a <span class="ad">word</span> stays</p>') == ["a word stays"]
    for gone in (
        '<article class="comment">gone</article>', '<div class="reader-comments"><p>gone</p></div>', '<section id="comments">gone</section>', '<div class="related-posts"><ul><li>gone</ul></div>',
        '<div class="share-buttons"><a>gone</a></div>', '<div aria-label="advertisement">gone</div>', '<div role="complementary">gone</div>', '<label>gone</label>', '<article class="teaser">gone</article>',
    ):
        assert inside(gone) == [], gone


def test_html_takes_one_article():
    text = lambda source: [b[1] for b in html_text.Page(source).main()]
    assert text("<article class='teaser'>a long enough teaser text</article><article><p>the story</p></article>") == ["the story"]
    assert text("<article>short</article><article><p>the longest of them</p></article><article>last</article>") == ["the longest of them"]
    assert text("<main><h1>Title</h1><article><p>story</p></article><aside>x</aside></main>") == ["Title", "story"]
    assert text("<main><h1>Index</h1><article>one</article><article>the second</article></main>") == ["the second"]
    assert text("<div class='sitefooter'>foot</div><div><p>story</p></div><div><a href='x'>link</a> <a>link</a></div>") == ["story"]
    assert text("<ul><li><a>only</a><li><a>links</a></ul>") == ["only", "links"]
    assert len(text("<article><p>" + "word " * 400_000 + "</article>")[0]) == 1_999_999


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, compression):
    inner = "x WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n é"
    rows = [(1, "http://a", inner), (2, "b", inner), (3, "c", None), (4, None, ""), (None, "u", "zz"), (5, "u", "zz"), (6, "a\r\nX: y", "WARC/1.0\r\n" * 3), (7, "u", "long " * 5000), (8, "u", "z"), (8, "u", "z")]
    rows += [(100 + i, "w", f"page {i % 40} " * (i % 30)) for i in range(150)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for least in (0, 3):
            folder = f"{spark.conf.get('spark.checkpoint.dir')}/warc-{uuid.uuid4().hex}"
            warc.write_archives(frame(spark, rows, "page_id long, url string, html string").coalesce(2), folder, min_bytes=least, compression=compression)
            got = warc.page_records(warc.read_archives(spark, folder, compression, stretch_bytes=2500)).collect()
            assert len(got) == len(rows) and all(r.intact for r in got)
            digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
            first = {}
            for i, _, h in rows:
                if i is not None:
                    first[h or ""] = min(i, first.get(h or "", i))
            want = sorted(
                (
                    (i, len((h or "").encode()), digest(h), "revisit", first[h or ""])
                    if i != first[h or ""] and len((h or "").encode()) >= least
                    else (i, len((h or "").encode()), digest(h), "response", None)
                    for i, _, h in rows
                ),
                key=str,
            )
            assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def packed(record, level=6):
    """A gzip member with its length in the field sl, made without the operator."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = packer.compress(record) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x0c\x00sl\x08\x00" + struct.pack("<II", 32 + len(data), len(record))
    return head + data + struct.pack("<II", zlib.crc32(record), len(record))


def warc_record(number, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    return head % (number, digest, len(block)) + block + b"\r\n\r\n"


def test_warc_members_inside_payloads(spark, tmp_path):
    """A whole member that lies uncompressed in a payload, and a mere magic, are no records."""
    forged = packed(warc_record(999, b"forged"))
    payloads = [b"first", b"x" + forged + b"y" + forged, b"\x1f\x8b\x08\x04", b"last" * 2000]
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_bytes(b"".join(packed(warc_record(i, p), 0) for i, p in enumerate(payloads)))
    records = warc.read_archives(spark, str(tmp_path), stretch_bytes=300)
    got = warc.page_records(records).collect()
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), True) for i, p in enumerate(payloads)] * 2
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.intact) for r in got) == sorted(want)


def test_warc_is_readable_gzip(spark, tmp_path):
    """Any gzip reader gives the records in order; a record of over 16 MB needs an empty member behind it."""
    html = ["short", "é" * 9_000_000, None]
    folder = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string"), folder)
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{folder}/part-*"))
    assert text.count(b"WARC/1.0\r\n") == 3 and text.endswith(b"\r\n\r\n") and html[1].encode() in text
    got = {r.page_id: r for r in warc.page_records(warc.read_archives(spark, folder)).collect()}
    assert {i: r.payload_bytes for i, r in got.items()} == {0: 5, 1: 18_000_000, 2: 0} and all(r.intact for r in got.values())
    empty = str(tmp_path / "empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    labels = read_table(spark, SF, "labels")
    docs = read_table(spark, SF, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, stage(spark, docs, SF).persist())
        docs = out[name][1]
    before, after = out["toxicity"]
    called = toxicity.toxicity(before, labels).where("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.join(called, "doc_id", "left_anti").collect())
    before, after = out["exact_dedup"]
    last = {}
    for r in before.collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())
    before, after = out["ngram_jaccard_join"]
    classes = jaccard_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in classes.items() if i == c)
    before, after = out["decontamination"]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").limit(40).collect()]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    sample = [r for r in before.collect() if r.doc_id in gone or r.doc_id % 9 == 0]
    assert all(brute_window_hits(r.text, items)[4] == (r.doc_id in gone) for r in sample if len(r.text or "") < 4000)
    before, after = out["byte_bpe"]
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect()}
    for b, a in list(out.values())[:-1]:
        assert a.columns == b.columns
    for _, a in out.values():
        a.unpersist()


def test_pipeline_edges(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in EDGE]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = stage(spark, docs, SF)
        assert name == "byte_bpe" or got.columns == docs.columns
        assert name == "byte_bpe" or got.where("score IS NULL OR row_digest IS NULL OR predicted IS NULL").count() == 0
        n = got.count()
        assert n == {"exact_dedup": 8, "ngram_jaccard_join": 9}.get(name, len(EDGE)), (name, n)


def test_operators_run_where_workers_have_no_copy_of_the_package(tmp_path):
    """A driver that finds the package by sys.path alone, in a folder of its own."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import public_tokenizers
from voxframe.session import local_session
from voxframe.llm import byte_bpe, chat_format, merkle, spelling, token_counts
spark = local_session(cores="2", shuffle_partitions=2, spark__checkpoint__dir={str(tmp_path / "shared")!r})
docs = spark.createDataFrame([(1, "wording wordings wording wordings " * 9, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
def probe(batches):
    for b in batches:
        import importlib.util
        b["found"] = importlib.util.find_spec("voxframe") is not None
        yield b[["found"]]
assert not docs.mapInPandas(probe, "found boolean").first().found
path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
coded = byte_bpe.byte_bpe(docs, path, pattern)
assert bytes(byte_bpe.decode(coded, path).first().decoded).decode().startswith("wording")
assert token_counts.token_counts(docs, path, pattern).count()
assert merkle.merkle_manifest(docs).first().verified
assert spelling.spelling_variants(docs).count() == 2
talk = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
assert chat_format.read_back(chat_format.chat_format(talk)).first().n_turns == 1
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
