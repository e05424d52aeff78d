"""Text queries over ``documents``, ``conversations`` and messages made of ``events``.

The prose tables hold almost none of the patterns the operators look for, so
messages are built by one expression that both engines evaluate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import tables
from voxframe.functions import textrules as tr
from voxframe.functions.scalar import rnd
from voxframe.operators import text as ops
from voxframe.plans.registry import query, rnd_sql as r, spread, table, with_sql
from voxframe.session import shared_dir
from voxframe.sources import files

MESSAGE = (
    "CASE event_type WHEN 'error' THEN 'WHY is it BROKEN again?!' WHEN 'purchase' THEN 'Amazing!!! **deal** and | pipes | ok.' "
    "WHEN 'view' THEN 'Hmm... still 42 items, 50% off.' WHEN 'click' THEN 'please ~' ELSE 'Note ' || CAST(event_id AS STRING) || ' of course, thanks' END"
)

MARKED_UP = (
    "CASE doc_id % 7 "
    "WHEN 0 THEN '# Title ' || CAST(doc_id AS STRING) || chr(10) || text || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'tail' "
    "WHEN 1 THEN '> quote' || chr(10) || '- item **bold** and *it* with `code` here' || chr(10) || '1. first __under__ line' || chr(10) || text "
    "WHEN 2 THEN 'see [link text](http://x.y/z) and ![img](a.png) now' || chr(10) || '---' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end /home-dir x' "
    "WHEN 3 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| c | d |' || chr(10) || text "
    "WHEN 4 THEN '──── Section ────' || chr(10) || text || chr(10) || 'unclosed ``` fence ' || text "
    "WHEN 5 THEN '<think>hidden ' || text || '</think>/no_think' || chr(10) || '  /clear  ' || chr(10) || 'About 21 of 1000 cost -7 or 50% v2 3.14' || chr(10) || text "
    "ELSE text || chr(92) || 'n *' || chr(10) || '* star' || chr(92) END"
)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "events")).select(
        F.col("user_id").alias("session_id"), "ts", "event_id", "event_type", "value", F.expr(MESSAGE).alias("text")
    )


MESSAGES = {"msg": f"SELECT user_id AS session_id, ts, event_id, event_type, value, {MESSAGE} AS text FROM events"}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text"))


def marked_up(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "source", F.expr(MARKED_UP).alias("text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewrite_sql(expr: str, rules, flags: str = "g") -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement.replace('$1', chr(92) + '1'))}, '{flags}')"
    return expr


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def _list_sql(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def number_words_sql(n: str) -> str:
    """Cardinal words of a BIGINT expression."""

    def below(x: str, ones) -> str:
        return (
            f"array_to_string(list_filter([{_list_sql(tr.HUNDREDS)}[{x} // 100 + 1], "
            f"CASE WHEN {x} % 100 BETWEEN 10 AND 19 THEN {_list_sql(tr.TEENS)}[{x} % 10 + 1] ELSE {_list_sql(tr.TENS)}[{x} % 100 // 10 + 1] END, "
            f"CASE WHEN {x} % 100 BETWEEN 10 AND 19 THEN '' ELSE {_list_sql(ones)}[{x} % 10 + 1] END], lambda w: w <> ''), ' ')"
        )

    def plural(x: str, forms) -> str:
        return f"CASE WHEN {x} % 100 BETWEEN 11 AND 19 THEN '{forms[2]}' WHEN {x} % 10 = 1 THEN '{forms[0]}' WHEN {x} % 10 BETWEEN 2 AND 4 THEN '{forms[1]}' ELSE '{forms[2]}' END"

    forms = {18: tr.QUINTILLION_FORMS, 15: tr.QUADRILLION_FORMS, 12: tr.TRILLION_FORMS, 9: tr.MILLIARD_FORMS, 6: tr.MILLION_FORMS, 3: tr.THOUSAND_FORMS}
    group = lambda p: f"CAST(abs(CAST({n} AS HUGEINT)) // {10**p} % 1000 AS BIGINT)"
    scaled = [
        f"CASE WHEN {group(p)} > 0 THEN {below(group(p), tr.ONES_FEMININE if p == 3 else tr.ONES_MASCULINE)} || ' ' || {plural(group(p), f)} END"
        for p, f in forms.items()
    ]
    return (
        f"array_to_string(list_filter([CASE WHEN {n} < 0 THEN '{tr.MINUS_WORD}' END, CASE WHEN {n} = 0 THEN '{tr.ZERO_WORD}' END, "
        + ", ".join(scaled)
        + f", CASE WHEN {group(0)} > 0 THEN {below(group(0), tr.ONES_MASCULINE)} END], lambda w: w IS NOT NULL), ' ')"
    )


def spoken_sql(source: str) -> dict[str, str]:
    """CTEs turning ``source(doc_id, s)`` into ``spoken(doc_id, s)``."""
    prev, cur, nxt = "list_extract(tok, i - 1)", "list_extract(tok, i)", "coalesce(list_extract(tok, i + 1), '')"
    is_num = f"regexp_full_match({cur}, '-?[0-9]+')"
    free = (
        f"NOT (i > 1 AND regexp_matches(right({prev}, 1), '[\\p{{L}}.]')) AND NOT regexp_matches(left({nxt}, 1), '[.\\p{{L}}_]')"
    )
    return {
        "toks": f"SELECT doc_id, regexp_extract_all(s, '-?[0-9]+|[^0-9-]+|-') AS tok FROM {source}",
        "pos": "SELECT doc_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM toks",
        "one": f"SELECT doc_id, i, {cur} AS t, {is_num} AND {free} AS conv, left({nxt}, 1) = '%' AS pct FROM pos",
        "two": "SELECT *, lag(conv AND pct, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS eaten FROM one",
        "nums": f"SELECT t, {number_words_sql('n')} AS w FROM (SELECT DISTINCT t, TRY_CAST(t AS BIGINT) AS n FROM two WHERE conv AND TRY_CAST(t AS BIGINT) IS NOT NULL)",
        "said": f"SELECT doc_id, i, CASE WHEN w IS NOT NULL THEN w || CASE WHEN pct THEN ' {tr.PERCENT_WORD}' ELSE '' END WHEN eaten THEN substr(two.t, 2) ELSE two.t END AS p "
        "FROM two LEFT JOIN nums ON conv AND two.t = nums.t",
        "spoken": "SELECT doc_id, string_agg(p, '' ORDER BY i) AS s FROM said GROUP BY doc_id",
    }


def _markdown_sql(expr: str) -> str:
    scrubbed = strip_sql(rewrite_sql(expr, tr.MODEL_ARTEFACTS))
    before = rewrite_sql(scrubbed, tr.MARKDOWN_BEFORE_ROWS)
    # rows first lose what follows their last pipe, then are handled line by line
    rows = rewrite_sql(before, [(r"(?m)^(\|.+\|)\s*$", "$1")])
    lined = (
        f"array_to_string([CASE WHEN regexp_full_match(l, '\\|(.+)\\|') THEN trim(replace(l[2:-2], '|', ' ')) ELSE l END "
        f"for l in string_split({rows}, chr(10))], chr(10))"
    )
    return rewrite_sql(lined, tr.MARKDOWN_AFTER_ROWS)


CLEAN = {
    "raw": f"SELECT doc_id, source, {MARKED_UP} AS text FROM documents",
    "md": f"SELECT doc_id, {_markdown_sql('text')} AS s FROM raw",
    **spoken_sql("md"),
    "clean": f"SELECT raw.doc_id, source, text, {strip_sql('coalesce(spoken.s, $$$$)')} AS clean FROM raw LEFT JOIN spoken USING (doc_id)",
}


@query("normalise_messages", with_sql(CLEAN, "SELECT doc_id, clean FROM clean"))
def normalise_messages(spark, sf):
    return ops.normalise_messages(marked_up(spark, sf)).select("doc_id", "clean")


@query(
    "removal_counts",
    with_sql(
        CLEAN,
        "SELECT source, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(clean)) AS BIGINT) AS chars_after, count(*) FILTER (strlen(clean) <= 2) AS dropped FROM clean GROUP BY source",
    ),
)
def removal_counts(spark, sf):
    return ops.removal_counts(ops.normalise_messages(marked_up(spark, sf)), ["source"])


@query(
    "number_words",
    f"WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS n FROM orders) SELECT o_orderkey, n, {number_words_sql('n')} AS said FROM n",
)
def number_words(spark, sf):
    n = F.floor(F.col("o_totalprice") * 100) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return table(spark, sf, "orders").select("o_orderkey", n.alias("n"), tr.number_words(n).alias("said"))


@query(
    "spoken_numbers",
    f"SELECT event_id, 'sold ' || {number_words_sql('event_id')} || ' at ' || {number_words_sql('(event_id % 101)')} || ' {tr.PERCENT_WORD}, v' || event_id || ' x' || event_id || '.5 and ' || event_id || '.' AS said FROM events",
)
def spoken_numbers(spark, sf):
    i = F.col("event_id").cast("string")
    text = F.concat(
        F.lit("sold "), i, F.lit(" at "), (F.col("event_id") % 101).cast("string"), F.lit("%, v"), i, F.lit(" x"), i, F.lit(".5 and "), i, F.lit(".")
    )
    return table(spark, sf, "events").select("event_id", tr.normalise_numbers(text).alias("said"))


@query(
    "remove_code",
    f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({MARKED_UP}, '(?s)```.*?```', '', 'g'), '(?s)```.*', ''), '`[^`]*`', '', 'g') AS kept FROM documents",
)
def remove_code(spark, sf):
    return marked_up(spark, sf).select("doc_id", tr.remove_code(F.col("text")).alias("kept"))


CUTS = "string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n\\n+', chr(1), 'g'), chr(1))"


@query(
    "sentence_chunks",
    f"WITH c AS (SELECT doc_id, list_filter([{strip_sql('p')} for p in {CUTS}], lambda p: strlen(p) > 2) AS ch FROM documents) "
    "SELECT doc_id, CAST(generate_subscripts(ch, 1) - 1 AS INTEGER) AS chunk_idx, unnest(ch) AS chunk FROM c",
)
def sentence_chunks(spark, sf):
    return ops.chunk_messages(documents(spark, sf), ["doc_id"])


@query(
    "drained_chunks",
    f"WITH c AS (SELECT doc_id, {CUTS} AS p FROM documents WHERE true), d AS (SELECT doc_id, p, len(p) - 1 AS k FROM c) "
    f"SELECT doc_id, len(list_filter([{strip_sql('x')} for x in p[1:k]], lambda x: strlen(x) > 2)) AS n_chunks, k AS cuts FROM d",
)
def drained_chunks(spark, sf):
    """Complete chunks of a whole text, and the cuts that make them; the rest stays in the buffer."""
    docs = documents(spark, sf)
    return docs.select(
        "doc_id",
        F.size(tr.chunks(F.col("text"))).cast("bigint").alias("n_chunks"),
        (F.size(tr.pieces(F.col("text"))) - 1).cast("bigint").alias("cuts"),
    )


_STROKE = tr.STROKE
STROKES = {
    "raw": "SELECT doc_id, text FROM documents",
    "x": f"SELECT doc_id, regexp_extract_all(text, {quoted(_STROKE)}, 1) AS b, regexp_extract_all(text, {quoted(_STROKE)}, 2) AS e FROM raw",
    "y": f"SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, {strip_sql('unnest(b)')} AS text, unnest(e) AS d FROM x",
    "st": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stroke_idx, text, CASE "
    + " ".join(f"WHEN d = {quoted(k)} THEN '{v}'" for k, v in tr.DELIMITERS.items())
    + " END AS delimiter FROM y WHERE text <> ''",
}


@query("strokes", with_sql(STROKES, "SELECT doc_id, CAST(stroke_idx AS INTEGER) AS stroke_idx, text, delimiter FROM st"))
def strokes(spark, sf):
    return ops.stroke_rows(documents(spark, sf), ["doc_id"])


@query(
    "pause_budget",
    with_sql(
        {
            **STROKES,
            "b": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in tables.BREAK_MS.items()) + ") t(delimiter, ms)",
        },
        "SELECT doc_id, CAST(coalesce(sum(ms), 0) AS BIGINT) AS pause_ms FROM documents LEFT JOIN st USING (doc_id) LEFT JOIN b USING (delimiter) GROUP BY doc_id",
    ),
)
def pause_budget(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", tr.pause_budget_ms(tr.strokes(F.col("text"))).alias("pause_ms"))


def _emotion_ctes(source: str = "msg", keys: str = "session_id, ts, event_id") -> dict[str, str]:
    toks = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
    caps = "len(list_filter(tk, lambda w: strlen(w) >= 3 AND regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')))"
    shout = "regexp_matches(text, '[!]{3,}')"
    special = {
        "caps-lock": f"({caps} >= 2 OR ({caps} = 1 AND len(tk) <= 3))",
        "double-exclamation": f"(regexp_matches(text, '[!]{{2}}') AND NOT {shout})",
        "short-aggressive": f"(len(tk) < 6 AND regexp_matches(text, '[!?]') AND NOT {shout})",
    }
    fired = [
        (c, w, n, special[n] if p is None else f"regexp_matches(text, {quoted('(?i)' + p)})") for c, w, n, p in tr.EMOTION_RULES
    ]
    scores = ", ".join(
        "(" + " + ".join(f"CASE WHEN {hit} THEN {w} ELSE 0 END" for c, w, _, hit in fired if c == cls) + f") AS {cls}"
        for cls in tr.EMOTION_CLASSES
    )
    top = "greatest(" + ", ".join(tr.EMOTION_CLASSES) + ")"
    pick = " ".join(f"WHEN {cls} = {top} THEN '{cls}'" for cls in reversed(tr.EMOTION_CLASSES))
    signals = "concat_ws(',', " + ", ".join(f"CASE WHEN {hit} THEN '{n}' END" for _, _, n, hit in fired) + ")"
    return {
        "tk": f"SELECT *, {toks} AS tk FROM {source}",
        "sc": f"SELECT *, {scores}, {signals} AS signals FROM tk",
        "em": f"SELECT {keys}, text, CASE WHEN {top} = 0 THEN 'neutral' {pick} END AS emotion, least(1.0, {top} / 4.0)::DOUBLE AS confidence, signals FROM sc",
    }


EMOTIONS = {**MESSAGES, **_emotion_ctes()}


@query("message_emotion", with_sql(EMOTIONS, "SELECT event_id, emotion, confidence, signals FROM em"))
def message_emotion(spark, sf):
    tagged = ops.tag_emotion(messages(spark, sf))
    return tagged.select("event_id", "emotion", "confidence", F.array_join("signals", ",").alias("signals"))


@query(
    "emotion_mix",
    with_sql(EMOTIONS, f"SELECT session_id, emotion, count(*) AS messages, {r('avg(confidence)', 6)} AS mean_confidence FROM em GROUP BY ALL"),
)
def emotion_mix(spark, sf):
    mix = ops.emotion_mix(ops.tag_emotion(messages(spark, sf)), ["session_id"])
    return mix.withColumn("mean_confidence", rnd(F.col("mean_confidence"), 6))


@query(
    "emotion_weights",
    "WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'angry' WHEN 1 THEN 'frustrated' WHEN 2 THEN 'sarcastic' WHEN 3 THEN 'excited' WHEN 4 THEN 'cute' ELSE 'neutral' END AS emotion, least(value / 100.0, 1.0) AS intensity FROM events), "
    "p AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{e}', {m}::DOUBLE, {i}::DOUBLE, {h}, '{b}')" for e, (m, i, h, b) in tr.PEAK_WEIGHTS.items())
    + ") t(emotion, m, i, h, b)) "
    f"SELECT event_id, {r('1 + intensity * (m - 1)', 6)} AS mat_multiplier, {r('1 + intensity * (i - 1)', 6)} AS interject_multiplier, CASE WHEN intensity >= 0.5 THEN h ELSE 1 END AS heat_min, CASE WHEN intensity >= 0.5 THEN b ELSE 'neutral' END AS word_bias FROM e JOIN p USING (emotion)",
)
def emotion_weights(spark, sf):
    named = F.expr(
        "CASE event_id % 7 WHEN 0 THEN 'angry' WHEN 1 THEN 'frustrated' WHEN 2 THEN 'sarcastic' WHEN 3 THEN 'excited' WHEN 4 THEN 'cute' ELSE 'neutral' END"
    )
    states = table(spark, sf, "events").select(
        "event_id", named.alias("emotion"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("intensity")
    )
    out = ops.weights_at(states)
    return out.select(
        "event_id", rnd(F.col("mat_multiplier"), 6).alias("mat_multiplier"), rnd(F.col("interject_multiplier"), 6).alias("interject_multiplier"), "heat_min", "word_bias"
    )


@query(
    "placement_scores",
    "WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s FROM documents), "
    "w AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS nw, length(s) - length(replace(s, ',', '')) AS nc FROM s) "
    f"SELECT doc_id, count(*) AS sentences, {r('sum(least(0.25 + CASE WHEN regexp_matches(s, $$(?i)' + tr.TECH_WORDS + '$$) THEN 0.2 ELSE 0 END + CASE WHEN nw > 12 THEN 0.1 ELSE 0 END, 1))', 4)} AS prefix, "
    f"{r('sum(least(nc * 0.4, 1.0))', 4)} AS mid, {r('sum(CASE WHEN regexp_matches(s, $$[?]\\s*$$$) THEN 0 ELSE 0.55 + CASE WHEN nw > 8 THEN 0.2 ELSE 0 END END)', 4)} AS suffix FROM w GROUP BY doc_id".replace(
        "$$[?]\\s*$$$", "'[?]\\s*$'"
    ),
)
def placement_scores(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(tr.sentences(F.col("text"))).alias("s"))
    scored = rows.withColumn("p", tr.placement_scores(F.col("s")))
    return scored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), *[rnd(F.sum(f"p.{c}"), 4).alias(c) for c in ("prefix", "mid", "suffix")]
    )


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), '\\s+'), lambda w: w <> '')"

_U = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_SAID = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_chance = lambda slot, where: _U.format(f"doc_id || '|7|{slot}|' || {where} || '|p'") + " / 4294967296.0::DOUBLE"
_aim = lambda slot, where: _U.format(f"doc_id || '|7|{slot}|' || {where} || '|w'") + f" / 4294967296.0::DOUBLE * (SELECT sum(share)::BIGINT FROM pool WHERE slot = '{slot}')"
_AUGMENTED = with_sql(
    {
        "tw": f"SELECT term, 1.0::DOUBLE / (1.0::DOUBLE + count(*)) AS weight FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) WHERE length(term) BETWEEN 4 AND 6 GROUP BY term",
        "pool": f"SELECT ['prefix', 'mid', 'suffix'][length(term) - 3] AS slot, term, CAST(round(weight * 1e9::DOUBLE) AS BIGINT) AS share, {_U.format('term')} AS place FROM tw",
        "cum": "SELECT slot, term, sum(share) OVER (PARTITION BY slot ORDER BY place, encode(term))::BIGINT AS upto FROM pool WHERE share > 0",
        "s0": f"SELECT doc_id, unnest({_SAID}) AS s, generate_subscripts({_SAID}, 1) - 1 AS i FROM documents",
        "sc": "SELECT *, 0.25::DOUBLE + CASE WHEN regexp_matches(s, '(?i)" + tr.TECH_WORDS + "') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN nw > 12 THEN 0.1::DOUBLE ELSE 0 END AS pp, least((len(string_split(s, ',')) - 1) * 0.4::DOUBLE, 1.0) AS pm, "
        "CASE WHEN regexp_matches(s, '[?]\\s*$') THEN 0 ELSE 0.55::DOUBLE + CASE WHEN nw > 8 THEN 0.2::DOUBLE ELSE 0 END END AS ps FROM (SELECT *, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS nw FROM s0)",
        "dp": f"SELECT doc_id, i, {_aim('prefix', 'i')} AS aim, 'prefix' AS slot FROM sc WHERE {_chance('prefix', 'i')} < 0.8::DOUBLE * pp UNION ALL "
        f"SELECT doc_id, i, {_aim('suffix', 'i')}, 'suffix' FROM sc WHERE {_chance('suffix', 'i')} < 0.8::DOUBLE * ps",
        "pk": "SELECT dp.doc_id, dp.i, dp.slot, cum.term FROM dp ASOF JOIN cum ON dp.slot = cum.slot AND dp.aim <= cum.upto",
        "ld": "SELECT sc.*, coalesce(a.term || ' ', '') || s AS led, b.term AS tail FROM sc LEFT JOIN pk a ON a.doc_id = sc.doc_id AND a.i = sc.i AND a.slot = 'prefix' LEFT JOIN pk b ON b.doc_id = sc.doc_id AND b.i = sc.i AND b.slot = 'suffix'",
        "cl": "SELECT doc_id, i, pm, tail, unnest(string_split(led, ',')) AS c, generate_subscripts(string_split(led, ','), 1) - 1 AS k FROM ld",
        "dm": f"SELECT doc_id, i, k, {_aim('mid', chr(105) + ' || $$|$$ || k')} AS aim FROM cl WHERE k > 0 AND {_chance('mid', chr(105) + ' || $$|$$ || k')} < 0.8::DOUBLE * pm",
        "pm": "SELECT dm.doc_id, dm.i, dm.k, cum.term FROM dm ASOF JOIN (SELECT * FROM cum WHERE slot = 'mid') AS cum ON dm.aim <= cum.upto",
        "jn": "SELECT cl.doc_id, cl.i, any_value(tail) AS tail, string_agg(coalesce(' ' || pm.term || ',', '') || c, ',' ORDER BY cl.k) AS s FROM cl LEFT JOIN pm ON pm.doc_id = cl.doc_id AND pm.i = cl.i AND pm.k = cl.k GROUP BY cl.doc_id, cl.i",
        "vo": "SELECT doc_id, i, CASE WHEN tail IS NULL THEN s ELSE regexp_replace(s, '[.!?]+$', '') || tail || coalesce(nullif(regexp_extract(s, '[.!?]+$'), ''), '.') END AS s FROM jn",
        "wh": "SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS w FROM vo GROUP BY doc_id",
    },
    "SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(w, '') END AS augmented FROM documents d LEFT JOIN wh ON wh.doc_id = d.doc_id",
)


@query("augmented_sentences", _AUGMENTED)
def augmented_sentences(spark, sf):
    """Seeded insertions of the documents' own words of four, five and six letters, rare ones more often."""
    docs = documents(spark, sf).select("doc_id", "text")
    size = F.char_length("term")
    slot = F.when(size == 4, "prefix").when(size == 5, "mid").when(size == 6, "suffix")
    pools = ops.term_weights(docs).select(slot.alias("slot"), "term", "weight")
    return ops.augment_sentences(docs, pools, 0.8, "doc_id", seed=7).select("doc_id", "augmented")


_COMMENT = (
    "CASE event_type WHEN 'error' THEN 'noise' || chr(10) || 'PREFIX: Well,' WHEN 'purchase' THEN '  SUFFIX:  indeed ' WHEN 'view' THEN 'MID: you know' WHEN 'click' THEN chr(10) || ' plain words ' || chr(10) || 'more' ELSE '  ' END"
)


@query(
    "commentary",
    with_sql(
        {
            **MESSAGES,
            "p": "SELECT event_id, event_type, text, CASE event_type WHEN 'error' THEN 'prefix' WHEN 'view' THEN 'mid' ELSE 'suffix' END AS placement, "
            "CASE event_type WHEN 'error' THEN 'Well,' WHEN 'purchase' THEN 'indeed' WHEN 'view' THEN 'you know' WHEN 'click' THEN 'plain words' END AS commentary FROM msg",
        },
        "SELECT event_id, placement, commentary, CASE event_type WHEN 'error' THEN 'Well, ' || text WHEN 'purchase' THEN regexp_replace(text, '[.]$', '') || ', indeed.' "
        "WHEN 'view' THEN 'Hmm... still 42 items, you know, 50% off.' WHEN 'click' THEN text || ', plain words.' ELSE text END AS spoken FROM p",
    ),
)
def commentary(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.expr(MESSAGE).alias("text"), F.expr(_COMMENT).alias("raw"))
    out = ops.apply_commentary(ops.parse_commentary(raw))
    return out.select("event_id", "placement", "commentary", "spoken")


_SHADE = "CASE event_id % 6 WHEN 0 THEN 'Whisper' WHEN 1 THEN 'Intense+Loose+Hot' WHEN 2 THEN 'hot + FLAT+firm' WHEN 3 THEN 'Flat+Calm+Hot' WHEN 4 THEN 'battle_cry' ELSE 'nonsense' END"


@query(
    "resolved_shades",
    "SELECT event_id, shade, CASE event_id % 6 WHEN 0 THEN 0.3 WHEN 1 THEN 1.2 WHEN 2 THEN 0.3 WHEN 4 THEN 1.5 ELSE 0.5 END::DOUBLE AS exaggeration, "
    "CASE event_id % 6 WHEN 0 THEN 0.6 WHEN 1 THEN 0.6 WHEN 2 THEN 0.2 WHEN 4 THEN 0.1 ELSE 0.5 END::DOUBLE AS cfg_weight, "
    "CASE event_id % 6 WHEN 0 THEN 0.65 WHEN 1 THEN 1.2 WHEN 2 THEN 1.2 WHEN 4 THEN 0.3 ELSE 0.8 END::DOUBLE AS temperature "
    f"FROM (SELECT event_id, {_SHADE} AS shade FROM events)",
)
def resolved_shades(spark, sf):
    beats = table(spark, sf, "events").select("event_id", F.expr(_SHADE).alias("shade"))
    return ops.resolve_shades(beats)


_BOARD = (
    "'[rage] attack ' || CAST(event_id AS STRING) || chr(10) || chr(10) || 'plain line' || chr(10) || '[E:' || CAST(event_id % 3 AS STRING) || '.0 A:0.0 W:9.9] numbers' || chr(10) || '[unknown] kept' || chr(10) || '[warm]  '"
)


@query(
    "storyboard",
    "SELECT event_id, 0 AS line_no, 'attack ' || event_id AS beat, 1.7::DOUBLE AS exaggeration, 0.1::DOUBLE AS cfg_weight, 0.3::DOUBLE AS temperature FROM events UNION ALL "
    "SELECT event_id, 2, 'plain line', 0.5, 0.5, 0.8 FROM events UNION ALL "
    "SELECT event_id, 3, 'numbers', greatest(least((event_id % 3)::DOUBLE, 1.7), 0.3), 0.1, 1.3 FROM events UNION ALL "
    "SELECT event_id, 4, '[unknown] kept', 0.5, 0.5, 0.8 FROM events",
)
def storyboard(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.expr(_BOARD).alias("text"))
    return ops.parse_storyboard(docs, ["event_id"])


_WER = {
    **MESSAGES,
    "pr": "SELECT session_id, event_id, text AS hyp, lag(text) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS ref FROM msg",
    "tk": f"SELECT session_id, event_id, {_TOKENS.format('ref')} AS rt, {_TOKENS.format('hyp')} AS ht FROM pr WHERE ref IS NOT NULL",
    "v": "SELECT *, list_distinct(list_concat(rt, ht)) AS d FROM tk",
    "sc": "SELECT session_id, event_id, levenshtein(array_to_string([chr(64 + CAST(list_position(d, w) AS INTEGER)) for w in rt], ''), array_to_string([chr(64 + CAST(list_position(d, w) AS INTEGER)) for w in ht], '')) AS edits, len(rt) AS ref_words FROM v",
}


def _message_pairs(spark, sf):
    from voxframe.operators.ordered import neighbours, with_block, with_position

    placed = with_position(with_block(messages(spark, sf), "ts"), ["session_id"], ["ts", "event_id"], "block", "pos")
    return neighbours(
        placed, ["session_id"], "pos", 1, 0, {"reference": lambda w: F.lag("text").over(w)}
    ).filter("reference IS NOT NULL").withColumnRenamed("text", "hypothesis")


@query(
    "transcript_wer",
    with_sql(_WER, f"SELECT event_id, edits, ref_words, {r('CASE WHEN ref_words > 0 THEN edits / ref_words * 100.0 ELSE 0 END', 6)} AS wer_pct FROM sc"),
)
def transcript_wer(spark, sf):
    scored = ops.score_transcripts(_message_pairs(spark, sf))
    return scored.select(
        "event_id", F.col("edits").cast("bigint").alias("edits"), F.col("ref_words").cast("bigint").alias("ref_words"), rnd(F.col("wer_pct"), 6).alias("wer_pct")
    )


@query(
    "corpus_wer",
    with_sql(
        _WER,
        f"SELECT session_id, count(*) AS pairs, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words, {r('sum(edits) * 100.0 / sum(ref_words)', 6)} AS wer_pct FROM sc GROUP BY session_id",
    ),
)
def corpus_wer(spark, sf):
    out = ops.corpus_wer(ops.score_transcripts(_message_pairs(spark, sf)), ["session_id"])
    return out.withColumn("wer_pct", rnd(F.col("wer_pct"), 6))


#: Edit distance a reference word at a time: what a row of the table costs from above, then from the left as a prefix minimum.
_TURN_WER = {
    "tk": f"SELECT a.conv_id, a.turn, {_TOKENS.format('b.text')} AS rt, {_TOKENS.format('a.text')} AS ht FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn",
    "dp": "SELECT conv_id, turn, 0 AS i, rt, ht, range(0, len(ht) + 1) AS row FROM tk UNION ALL "
    "SELECT conv_id, turn, i + 1, rt, ht, list_transform(range(0, len(ht) + 1), lambda j: list_min(off[1:j + 1]) + j) FROM ("
    "SELECT conv_id, turn, i, rt, ht, list_transform(range(0, len(ht) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(row[j + 1] + 1, row[j] + CASE WHEN rt[i + 1] = ht[j] THEN 0 ELSE 1 END) END - j) AS off "
    "FROM dp WHERE i < len(rt))",
    "sc": "SELECT conv_id, turn, row[len(ht) + 1] AS edits, len(rt) AS ref_words FROM dp WHERE i = len(rt)",
}


@query(
    "turn_wer",
    with_sql(_TURN_WER, f"SELECT conv_id, turn, edits, ref_words, {r('CASE WHEN ref_words > 0 THEN edits / ref_words * 100.0 ELSE 0 END', 6)} AS wer_pct FROM sc"),
)
def turn_wer(spark, sf):
    """Word error of every reply against the turn before it, whole texts."""
    turns = table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    pairs = turns.join(before, ["conv_id", "turn"]).withColumnRenamed("text", "hypothesis")
    return ops.score_transcripts(pairs).select("conv_id", "turn", F.col("edits").cast("bigint").alias("edits"), F.col("ref_words").cast("bigint").alias("ref_words"), rnd(F.col("wer_pct"), 6).alias("wer_pct"))


_LOG = (
    "CASE event_id % 14 WHEN 0 THEN 'model already cached at /data/m' || CAST(event_id AS STRING) WHEN 1 THEN 'downloading x from HuggingFace' "
    "WHEN 2 THEN '[train] ' || CAST(event_id AS STRING) || ' WAV files' WHEN 3 THEN 'Processed ' || CAST(event_id AS STRING) || '/99999 files, 0.08 hours done' "
    "WHEN 4 THEN 'Finished processing 7 files in 1.25 hours' WHEN 5 THEN 'x SyntaxWarning: bad' WHEN 6 THEN 'step=' || CAST(event_id AS STRING) || ' foo loss=0.5' "
    "WHEN 7 THEN CAST(event_id AS STRING) || '/20000 [00:01, loss=0.75, accuracy=0.5]' WHEN 8 THEN '[train] merging LoRA: ckpt' || CAST(event_id AS STRING) WHEN 9 THEN '[train] training done in 55s' "
    "WHEN 10 THEN 'CUDA out of memory' WHEN 11 THEN '   ' WHEN 12 THEN '12.5 M Trainable params 4.1 G Total params' ELSE 'hello ' || CAST(event_id AS STRING) END"
)


def _log_lines(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.expr(_LOG).alias("value"))


@query(
    "log_events",
    "WITH l AS (SELECT event_id, event_id % 14 AS k FROM events) SELECT event_id, "
    "['checkpoint_cached', 'checkpoint_downloading', 'dataset_ready', 'vq_progress', 'vq_complete', '', 'training_step', 'log', 'merging_lora', 'training_complete', 'oom', '', 'model_loaded', 'log'][k + 1] AS event, "
    "CASE WHEN k = 3 THEN event_id WHEN k = 4 THEN 7 END AS files, CASE WHEN k = 2 THEN event_id END AS wav_files, CASE WHEN k = 6 THEN event_id END AS step, "
    "CASE WHEN k = 3 THEN 0.08 WHEN k = 4 THEN 1.25 END::DOUBLE AS hours, CASE WHEN k = 6 THEN 0.5 END::DOUBLE AS loss, CASE WHEN k = 0 THEN '/data/m' || event_id END AS path, CASE WHEN k = 8 THEN 'ckpt' || event_id END AS checkpoint, "
    "CASE WHEN k = 9 THEN 55 END::BIGINT AS elapsed_secs, CASE WHEN k = 12 THEN '12.5 M' END AS trainable, CASE WHEN k = 10 THEN 'CUDA out of memory' WHEN k = 7 THEN event_id || '/20000 [00:01, loss=0.75, accuracy=0.5]' WHEN k = 13 THEN 'hello ' || event_id END AS message "
    "FROM l WHERE k NOT IN (5, 11)",
)
def log_events(spark, sf):
    return ops.parse_logs(_log_lines(spark, sf)).select(
        "event_id", "event", "files", "wav_files", "step", "hours", "loss", "path", "checkpoint", "elapsed_secs", "trainable", "message"
    )


@query(
    "job_status",
    "SELECT user_id, max(CASE WHEN event_id % 14 = 7 THEN event_id END) AS step, max(CASE WHEN event_id % 14 = 7 THEN 0.75 END)::DOUBLE AS loss, CASE WHEN count(*) FILTER (event_id % 14 = 10) > 0 THEN 'failed' ELSE 'running' END AS state FROM events GROUP BY user_id",
)
def job_status(spark, sf):
    return ops.job_status(_log_lines(spark, sf), ["user_id"], "event_id")


_TALK = "'Please commit and push the Pull  Requests, then DEPLOYED builds; debugging tests on staging. ' || {0} || ' Git logs fixed'"
# word boundaries are Unicode here and ASCII in the check, so other letters become x
_ASCII = "regexp_replace(text, '[^ -~\\n]', 'x')"


@query(
    "glossary",
    "SELECT doc_id, "
    + rewrite_sql(_TALK.format("regexp_replace(text, '[^ -~\\n]', 'x', 'g')"), tr.GLOSSARY, "gi")
    + " AS said FROM documents",
)
def glossary(spark, sf):
    talk = documents(spark, sf).select("doc_id", F.expr(_TALK.format(_ASCII)).alias("text"))
    return talk.select("doc_id", tr.apply_glossary(F.col("text")).alias("said"))


_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


@query(
    "stress_annotation",
    f"SELECT doc_id, array_to_string([CASE WHEN regexp_matches(t, '^[{_LATIN}]') AND length(t) = 5 AND lower(t) < 'n' THEN substr(t, 1, 2) || '́' || substr(t, 3) ELSE t END "
    f"for t in regexp_extract_all(text, '[{_LATIN}]+|[^{_LATIN}]+')], '') AS annotated FROM documents",
)
def stress_annotation(spark, sf):
    """A dictionary of every five-letter word below 'n', looked up by join."""
    docs = documents(spark, sf).select("doc_id", "text")
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{_LATIN}]+"), F.lit(0))).alias("t"))
    entries = tokens.select(F.lower("t").alias("bare")).filter((F.length("bare") == 5) & (F.col("bare") < "n")).distinct()
    accented = F.concat(F.substring("bare", 1, 2), F.lit(ops.ACUTE), F.substring("bare", 3, 5))
    dictionary = entries.withColumn("accented", accented)
    return ops.annotate_stress(docs, dictionary, ["doc_id"], letters=_LATIN)


#: Characters of documents whose words are sorted and written by one task.
DICTIONARY_CHARS = 8_000_000


@query(
    "stress_dictionary",
    with_sql(
        {
            "w": "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{3,}'), 1) AS pos FROM documents",
            "f": "SELECT lower(w) AS bare, substr(w, 1, 1 + doc_id % (length(w) - 1)) || chr(769) || substr(w, 2 + doc_id % (length(w) - 1)) AS accented, doc_id % 2 AS load, doc_id, pos FROM w",
        },
        "SELECT bare, first(accented ORDER BY load, doc_id, pos) AS accented FROM f GROUP BY bare",
    ),
)
def stress_dictionary(spark, sf):
    """Two dictionaries of many files and splits, written from the documents; the first insert of a word wins."""
    docs = table(spark, sf, "documents")
    # files grow in number with the texts, not in size: a task sorts the words of one
    parts = max(4, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // DICTIONARY_CHARS))
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("pos", "bare"))
    cut = (F.lit(1) + F.col("doc_id") % (F.length("bare") - 1)).cast("int")
    form = F.concat(F.substring("bare", F.lit(1), cut), F.lit("'"), F.substring("bare", cut + 1, F.length("bare")))
    base = f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    for load in (0, 1):
        rows = words.where(F.col("doc_id") % 2 == load).withColumn("accented", form).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "pos")
        rows.select("bare", "accented").write.option("sep", "\t").option("header", True).csv(f"{base}/{load}")
    return files.read_stress(spark, [f"{base}/0", f"{base}/1"])


@query(
    "term_weights",
    f"SELECT term, count(*) AS uses, {r('1.0 / (1.0 + count(*))', 8)} AS weight FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term",
)
def term_weights(spark, sf):
    return ops.term_weights(table(spark, sf, "documents")).withColumn("weight", rnd(F.col("weight"), 8))


_MOOD = {
    "mood": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'diomedes' WHEN 1 THEN 'sidorovich' ELSE 'someone' END AS persona, least(value / 100.0, 1.0) AS a, (event_id % 11) / 10.0::DOUBLE AS d, (event_id % 7) / 6.0::DOUBLE AS v FROM events"
}


def _moods(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.expr("CASE event_id % 3 WHEN 0 THEN 'diomedes' WHEN 1 THEN 'sidorovich' ELSE 'someone' END").alias("persona"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("arousal"),
        ((F.col("event_id") % 11) / 10.0).alias("dominance"),
        ((F.col("event_id") % 7) / 6.0).alias("valence"),
    )


def _react(axis: int, x: str) -> str:
    whens = "".join(
        f" WHEN '{n}' THEN {tables.REST[p[axis][0]]} + ({x} - 0.5) * {tables.REACTS[p[axis][1]]}" for n, p in tables.PERSONAS.items()
    )
    return f"greatest(0.0, least(1.0, CASE persona{whens} ELSE 0.5 + ({x} - 0.5) END))"


@query(
    "persona_reaction",
    with_sql(
        _MOOD,
        f"SELECT event_id, persona, {r(_react(0, 'a'), 6)} AS arousal, {r(_react(1, 'd'), 6)} AS dominance, {r(_react(2, 'v'), 6)} AS valence FROM mood",
    ),
)
def persona_reaction(spark, sf):
    out = ops.persona_reaction(_moods(spark, sf))
    return out.select("event_id", "persona", *[rnd(F.col(a), 6).alias(a) for a in ops.AXES])


_PHASE = "CASE WHEN n <= 1 THEN 'climax' WHEN stroke_idx / (n - 1) < 0.2 THEN 'opening' WHEN stroke_idx / (n - 1) < 0.6 THEN 'build' WHEN stroke_idx / (n - 1) < 0.85 THEN 'climax' ELSE 'resolution' END"


def _bend(axis: int, name: str) -> str:
    parts = []
    for _, phase, *f in tables.ARC_PHASES:
        v = f"{name} * {f[axis]}"
        parts.append(f"WHEN '{phase}' THEN {f'least({v}, 1.0)' if (phase, ops.AXES[axis]) in tables.ARC_CAPPED else v}")
    return f"CASE phase {' '.join(parts)} END"


def _nudge(axis: int, name: str) -> str:
    parts = []
    for delim, *f in tables.DELIMITER_NUDGES:
        v = f"{name} * {f[axis]}"
        parts.append(f"WHEN '{delim}' THEN {f'least({v}, 1.0)' if ops.AXES[axis] in f[3] else v}")
    return f"CASE delimiter {' '.join(parts)} ELSE {name} END"


@query(
    "painted_strokes",
    with_sql(
        {
            **STROKES,
            "ph": f"SELECT doc_id, stroke_idx, delimiter, {_PHASE} AS phase, (doc_id % 10) / 9.0::DOUBLE AS a, (doc_id % 7) / 6.0::DOUBLE AS d, (doc_id % 4) / 3.0::DOUBLE AS v FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM st)",
            "bd": f"SELECT doc_id, stroke_idx, delimiter, phase, {_bend(0, 'a')} AS a, {_bend(1, 'd')} AS d, {_bend(2, 'v')} AS v FROM ph",
        },
        f"SELECT doc_id, CAST(stroke_idx AS INTEGER) AS stroke_idx, phase, {r(_nudge(0, 'a'), 6)} AS arousal, {r(_nudge(1, 'd'), 6)} AS dominance, {r(_nudge(2, 'v'), 6)} AS valence FROM bd",
    ),
)
def painted_strokes(spark, sf):
    # the strokes are a column of their own, or their count would be redone per row
    split = documents(spark, sf).select("doc_id", tr.strokes(F.col("text")).alias("parts"))
    rows = split.select("doc_id", F.size("parts").alias("n_strokes"), F.posexplode("parts").alias("stroke_idx", "s")).select(
        "doc_id", "n_strokes", "stroke_idx", "s.delimiter",
        ((F.col("doc_id") % 10) / 9.0).alias("arousal"), ((F.col("doc_id") % 7) / 6.0).alias("dominance"), ((F.col("doc_id") % 4) / 3.0).alias("valence"),
    )
    out = ops.paint_strokes(rows)
    return out.select("doc_id", "stroke_idx", "phase", *[rnd(F.col(a), 6).alias(a) for a in ops.AXES])


@query(
    "expression_blend",
    with_sql(
        _MOOD,
        f"SELECT event_id, {r('(0.3 + a * 1.2) * 0.3 + (0.3 + a * 1.4) * 0.7', 6)} AS excitement, {r('(0.6 - d * 0.4) * 0.3 + (0.6 - d * 0.5) * 0.7', 6)} AS assertiveness, {r('(0.4 + v * 0.8) * 0.3 + (0.3 + v) * 0.7', 6)} AS warmth FROM mood",
    ),
)
def expression_blend(spark, sf):
    axes = [F.col(a) for a in ops.AXES]
    pairs = zip(ops.tone_parameters(*axes), ops.arc_parameters(*axes), ("excitement", "assertiveness", "warmth"))
    return _moods(spark, sf).select("event_id", *[rnd(ops.blend(audio, text), 6).alias(n) for audio, text, n in pairs])


def _labelled(spark, sf):
    clips = table(spark, sf, "documents").select(F.col("doc_id").alias("clip"), "source")
    transcripts = table(spark, sf, "labels").select(
        F.col("doc_id").alias("clip"), F.when(F.col("quality") == 0, "").otherwise(F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("text")
    )
    return clips, transcripts


@query("labelled_clips", "SELECT doc_id AS clip, source, 't' || doc_id AS text FROM documents JOIN labels USING (doc_id) WHERE quality <> 0")
def labelled_clips(spark, sf):
    return ops.label_clips(*_labelled(spark, sf), required=True)


@query("unlabelled_clips", "SELECT doc_id AS clip, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)")
def unlabelled_clips(spark, sf):
    return ops.unlabelled_clips(*_labelled(spark, sf))


@query(
    "dataset_counters",
    "WITH j AS (SELECT n_chars / 100.0::DOUBLE AS s, doc_id IN (SELECT doc_id FROM labels WHERE quality <> 0) AS m FROM documents) "
    f"SELECT count(*) AS files, count(*) FILTER (m) AS matched, count(*) FILTER (m AND s <= 15) AS kept, {r('sum(s) FILTER (m AND s <= 15) / 60', 4)} AS minutes FROM j",
)
def dataset_counters(spark, sf):
    _, transcripts = _labelled(spark, sf)
    clips = table(spark, sf, "documents").select(F.col("doc_id").alias("clip"), (F.col("n_chars") / 100.0).alias("duration_s"))
    out = files.dataset_counters(clips, transcripts, max_s=15.0)
    return out.withColumn("minutes", rnd(F.col("minutes"), 4))


@query(
    "transcript_manifest",
    "SELECT 'clip' || (doc_id % 300) || '.wav' AS clip, arg_max(CASE WHEN doc_id % 4 = 0 THEN 'a | b' ELSE 'line ' || doc_id END, doc_id) AS text FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1",
)
def transcript_manifest(spark, sf):
    value = F.expr(
        "CASE WHEN doc_id % 5 = 0 THEN 'comment ' || doc_id ELSE ' clip' || (doc_id % 300) || '.wav |  ' || CASE WHEN doc_id % 4 = 0 THEN 'a | b ' ELSE 'line ' || doc_id END END"
    )
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), value.alias("value"))
    return files.parse_transcripts(lines)
