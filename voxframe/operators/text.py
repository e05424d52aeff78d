"""Table jobs over messages, transcripts, logs and manifests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxframe.functions import tables
from voxframe.functions import textrules as tr
from voxframe.functions.edits import word_edits
from voxframe.functions.scalar import clamp, let
from voxframe.operators.compare import literal_rows
from voxframe.operators.ordered import prefix
from voxframe.operators.recursions import kept
from voxframe.session import small_or_plain


def normalise_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Clean text: code and model artefacts out, markdown stripped, numbers spoken.

    The markdown step is a column of its own, as the number step reads it twice.
    """
    plain = df.withColumn("clean", tr.strip_markdown(tr.scrub_artefacts(F.col(text)), numbers=False))
    return plain.withColumn("clean", tr.strip(tr.normalise_numbers(F.col("clean"))))


def removal_counts(cleaned: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Characters before and after cleaning, and messages left empty, per source."""
    return cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.length(text)).alias("chars_before"),
        F.sum(F.length("clean")).alias("chars_after"),
        F.count_if(F.octet_length("clean") <= 2).alias("dropped"),
    )


def chunk_messages(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per sentence chunk, the flushed remainder included."""
    return df.select(*keys, F.posexplode(tr.all_chunks(F.col(text))).alias("chunk_idx", "chunk"))


def stroke_rows(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return df.select(*keys, F.posexplode(tr.strokes(F.col(text))).alias("stroke_idx", "s")).select(
        *keys, "stroke_idx", "s.text", "s.delimiter"
    )


def tag_emotion(df: DataFrame, text: str = "text") -> DataFrame:
    """Emotion, confidence and signals per text.

    Words and rule hits are columns of their own: each regex then runs once per
    row, however often its result is used.
    """
    staged = df.withColumn("_w", tr.words(F.col(text)))
    staged = staged.withColumn("_h", tr.emotion_hits(F.col(text), F.col("_w")))
    return staged.withColumn("_e", tr.emotion_reading(F.col("_h"))).select(*df.columns, "_e.*")


def emotion_mix(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Messages per emotion class and their mean confidence."""
    return tagged.groupBy(*keys, "emotion").agg(
        F.count(F.lit(1)).alias("messages"), F.avg("confidence").alias("mean_confidence")
    )


def weights_at(df: DataFrame, emotion: str = "emotion", intensity: str = "intensity") -> DataFrame:
    """Injection weights between neutral and the emotion's peak."""
    mat0, inter0, heat0, bias0 = tr.PEAK_WEIGHTS["neutral"]
    rows = [(e, *w) for e, w in tr.PEAK_WEIGHTS.items()]
    peak = F.broadcast(literal_rows(df, rows, f"{emotion} string, _mat double, _inter double, _heat int, _bias string"))
    level = F.col(intensity)
    strong = level >= 0.5
    return df.join(peak, emotion, "left").select(
        *[c for c in df.columns],
        (mat0 + level * (F.coalesce("_mat", F.lit(mat0)) - mat0)).alias("mat_multiplier"),
        (inter0 + level * (F.coalesce("_inter", F.lit(inter0)) - inter0)).alias("interject_multiplier"),
        F.when(strong, F.col("_heat")).otherwise(heat0).alias("heat_min"),
        F.when(strong, F.col("_bias")).otherwise(bias0).alias("word_bias"),
    )


def score_transcripts(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Word edits and error rate of every pair; 0 for an empty reference."""
    tokens = pairs.withColumn("_r", tr.wer_tokens(F.col(reference))).withColumn("_h", tr.wer_tokens(F.col(hypothesis)))
    scored = tokens.withColumn("edits", word_edits(F.col("_r"), F.col("_h"))).withColumn("ref_words", F.size("_r"))
    rate = F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words") * 100.0).otherwise(0.0)
    return scored.withColumn("wer_pct", rate).drop("_r", "_h")


def corpus_wer(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edits and words pooled over the corpus."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("edits").alias("edits"),
        F.sum("ref_words").alias("ref_words"),
        F.coalesce(F.try_divide(F.sum("edits") * 100.0, F.sum("ref_words")), F.lit(0.0)).alias("wer_pct"),
    )


def parse_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """Training-log lines as one wide event row; noise is dropped."""
    return lines.withColumn("_e", tr.log_event(F.col(line))).select("*", "_e.*").drop("_e").filter("event IS NOT NULL")


def job_status(lines: DataFrame, keys: Sequence[str], order: str, line: str = "value") -> DataFrame:
    """Latest progress and terminal state of each followed job."""
    seen = lines.withColumn("_p", tr.progress(F.col(line))).withColumn("_t", tr.terminal_state(F.col(line)))
    at = F.col(order)
    # a finished job stays in its first terminal state
    return seen.groupBy(*keys).agg(
        F.max_by("_p.step", F.when(F.col("_p.step").isNotNull(), at)).alias("step"),
        F.max_by("_p.loss", F.when(F.col("_p.step").isNotNull(), at)).alias("loss"),
        F.coalesce(F.min_by("_t", F.when(F.col("_t").isNotNull(), at)), F.lit("running")).alias("state"),
    )


def palette(df: DataFrame) -> DataFrame:
    """The default palette as a dimension table; a model may bring its own."""
    rows = [(name, tables.ENERGY[e], tables.AUTHORITY[a], tables.TONE[t]) for name, e, a, t in tables.SHADES]
    return literal_rows(df, rows, "shade string, exaggeration double, cfg_weight double, temperature double")


def _from_labels(name: Column) -> tuple[Column, Column, Column]:
    """Axis values of ``A+B+C``: three labels, one per axis, in any order."""
    labels = F.transform(F.split(F.lower(name), r"\+", -1), lambda t: F.trim(t))

    def values_on(axis: dict[str, float]) -> Column:
        known = F.create_map(*[F.lit(x) for kv in axis.items() for x in kv])
        return F.array_compact(F.transform(labels, lambda t: F.try_element_at(known, t)))

    out = []
    for axis in (tables.ENERGY, tables.AUTHORITY, tables.TONE):
        found = values_on(axis)
        out.append((F.size(found), F.try_element_at(found, F.lit(1))))
    fits = F.size(labels) == 3
    for count, _ in out:
        fits = fits & (count == 1)
    return tuple(F.when(fits, value) for _, value in out)


def resolve_shades(beats: DataFrame, shades: DataFrame | None = None, shade: str = "shade") -> DataFrame:
    """Expression parameters per beat: shade name, else labels, else defaults."""
    dim = (shades if shades is not None else palette(beats)).select(
        F.lower("shade").alias("_name"),
        F.col("exaggeration").alias("_e"),
        F.col("cfg_weight").alias("_c"),
        F.col("temperature").alias("_t"),
    )
    named = beats.withColumn("_name", F.lower(shade)).join(F.broadcast(dim) if shades is None else small_or_plain(dim), "_name", "left")
    labels = _from_labels(F.col(shade))
    values = [
        F.coalesce(F.col(n), label, F.lit(default))
        for n, label, default in zip(("_e", "_c", "_t"), labels, tables.SHADE_DEFAULT)
    ]
    return named.select(
        *beats.columns, *[v.alias(n) for v, n in zip(values, ("exaggeration", "cfg_weight", "temperature"))]
    )


def parse_storyboard(df: DataFrame, keys: Sequence[str], text: str = "text", shades: DataFrame | None = None) -> DataFrame:
    """Tagged lines as beats: ``[shade]`` or ``[E:x A:y W:z]``, else defaults."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "_raw"))
    lines = lines.withColumn("_line", tr.strip(F.col("_raw"))).filter("_line <> ''")
    tag = F.regexp_extract("_line", r"(?s)\[(.*?)\]", 1)
    rest = tr.strip(F.regexp_extract("_line", r"(?s)\[.*?\](.*)", 1))
    numbers = r"\[E:\s*([-\d.]+)\S*\s[^\]]*?A:\s*([-\d.]+)\S*\s[^\]]*?W:\s*([-\d.]+)\s*\]"
    part = lambda i, lo, hi: clamp(F.regexp_extract("_line", numbers, i).try_cast("double"), lo, hi)
    dim = (shades if shades is not None else palette(df)).select(
        F.col("shade").alias("_name"),
        F.col("exaggeration").alias("_e"),
        F.col("cfg_weight").alias("_c"),
        F.col("temperature").alias("_t"),
    )
    tagged = lines.withColumn("_name", F.lower(tag)).join(F.broadcast(dim) if shades is None else small_or_plain(dim), "_name", "left")
    given = F.struct(part(1, 0.3, 1.7).alias("e"), part(2, 0.1, 0.6).alias("c"), part(3, 0.3, 1.3).alias("t"))
    by_number = F.when(
        F.col("_line").rlike(numbers) & given["e"].isNotNull() & given["c"].isNotNull() & given["t"].isNotNull(), given
    )
    known = F.col("_e").isNotNull()
    is_tagged = known | by_number.isNotNull()
    e, c, t = tables.SHADE_DEFAULT
    beats = tagged.select(
        *keys,
        "line_no",
        F.when(is_tagged, rest).otherwise(F.col("_line")).alias("beat"),
        F.coalesce("_e", by_number["e"], F.lit(e)).alias("exaggeration"),
        F.coalesce("_c", by_number["c"], F.lit(c)).alias("cfg_weight"),
        F.coalesce("_t", by_number["t"], F.lit(t)).alias("temperature"),
    )
    return beats.filter("beat <> ''")


def parse_commentary(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Placement and text of a one-line commentary; null text when empty."""
    lines = F.filter(F.transform(F.split(raw, "\n"), tr.strip), lambda x: x != "")
    marked = F.filter(lines, lambda x: x.rlike(r"^(PREFIX|SUFFIX|MID):(?U)\s*\S"))
    first = F.try_element_at(marked, F.lit(1))
    placement = F.coalesce(F.lower(F.regexp_extract(first, r"^(PREFIX|SUFFIX|MID):", 1)), F.lit("suffix"))
    said = F.coalesce(
        tr.strip(F.regexp_replace(first, r"^(PREFIX|SUFFIX|MID):", "")), F.try_element_at(lines, F.lit(1))
    )
    return df.withColumn("placement", placement).withColumn("commentary", said)


def apply_commentary(df: DataFrame, text: str = "text") -> DataFrame:
    """Insert the commentary before, inside (last comma) or after the text."""
    whole = F.col(text)
    trimmed = F.regexp_replace(whole, r"(?U)\s+\z", "")
    body = F.regexp_replace(trimmed, r"[.!?]+\z", "")
    found = F.regexp_extract(trimmed, r"[.!?]+\z", 0)
    end = F.when(found == "", ".").otherwise(found)
    said = F.col("commentary")
    lead = F.when(said.endswith(","), " ").otherwise(", ")
    join = F.when(said.startswith(","), "").otherwise(", ")
    after = F.concat(body, join, said, end)
    middle = F.when(
        body.contains(","),
        F.concat(
            F.regexp_extract(body, r"(?s)^(.*),", 1), F.lit(", "), said, F.regexp_extract(body, r"(?s)^.*(,.*)\z", 1), end
        ),
    ).otherwise(after)
    placed = F.when(F.col("placement") == "prefix", F.concat(said, lead, whole)).when(F.col("placement") == "mid", middle)
    return df.withColumn("spoken", F.when(said.isNull(), whole).otherwise(placed.otherwise(after)))


CYRILLIC = "а-яА-ЯёЁ"
ACUTE = "́"


def restore_case(original: Column, accented: Column) -> Column:
    """Give the accented form the capitals of the original; marks do not count."""

    def cased(marks: Column, letters: Column) -> Column:
        def one(ch: Column, i: Column) -> Column:
            at = i + 1 - F.size(F.filter(F.slice(marks, 1, i), lambda c: c == ACUTE))
            source = F.try_element_at(letters, at)
            return F.when((ch != ACUTE) & source.rlike(r"\p{IsUppercase}"), F.upper(ch)).otherwise(ch)

        return F.array_join(F.transform(marks, one), "")

    return let(F.struct(F.split(accented, "").alias("m"), F.split(original, "").alias("l")), lambda s: cased(s["m"], s["l"]))


#: Characters of the texts that are annotated together.
ANNOTATED_CHARS = 4_000_000


def same_letters(df: DataFrame, letters: str) -> str:
    """The characters of a Java character class as a class that Python reads; empty if there are none."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = df.sparkSession.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").where(char.rlike(f"[{letters}]"))
    found = sorted(r.id for r in points.collect())
    starts = [p for p, before in zip(found, [-2, *found]) if p != before + 1]
    ends = [p for p, after in zip(found, [*found[1:], -2]) if after != p + 1]
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in zip(starts, ends))


def _annotated(keys: Sequence[str], letters: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Annotates the texts of a bucket by its accented words; texts with equal keys become one, token by token."""
    word = f"([{letters}]+)" if letters else "((?!))"

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        cut = re.compile(word).split
        forms: dict[str, list[str]] = {}
        for token, said in zip(words["_tok"].to_pylist(), words["said"].to_pylist()):
            forms.setdefault(token, []).append(said)
        spoken = {token: "".join(sorted(said)) for token, said in forms.items()}
        text = texts["_text"].to_pylist()
        same: dict[str, list[int]] = {}
        for row, key in enumerate(zip(*[texts[k].to_pylist() for k in keys])):
            same.setdefault(repr(key), []).append(row)
        out = []
        for rows in same.values():
            if len(rows) == 1:
                out.append("".join([spoken.get(token, token) for token in cut(text[rows[0]])]))
            else:
                tokens = [[token for token in cut(text[row]) if token] for row in rows]
                parts = [(at, said) for own in tokens for at, token in enumerate(own) for said in forms.get(token, (token,))]
                out.append("".join([said for _, said in sorted(parts)]))
        first = texts.select(list(keys)).take(pa.array([rows[0] for rows in same.values()], pa.int64()))
        return first.append_column("annotated", pa.array(out, pa.string()))

    return run


def annotate_stress(
    df: DataFrame, dictionary: DataFrame, keys: Sequence[str], text: str = "text", letters: str = CYRILLIC
) -> DataFrame:
    """Replace dictionary words by their accented form, keeping everything else.

    Texts are dealt by their keys into buckets that grow in number with the characters. A word
    goes to the dictionary by join once a bucket, however often it occurs, so the dictionary may
    outgrow memory: the optimiser broadcasts it only while it is small. Each text then moves
    once, to the accented words of its bucket. Empty texts give no row.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // ANNOTATED_CHARS))
    dealt = df.select(*keys, F.col(text).alias("_text"), F.pmod(F.hash(*keys), F.lit(buckets)).alias("_bucket")).where("_text <> ''")
    tokens = dealt.select("_bucket", F.explode(F.regexp_extract_all("_text", F.lit(f"[{letters}]+"), F.lit(0))).alias("_tok")).distinct()
    looked = tokens.withColumn("bare", F.lower("_tok")).join(dictionary.select("bare", "accented"), "bare")
    said = F.when(F.col("accented").isNull(), F.col("_tok")).otherwise(restore_case(F.col("_tok"), F.col("accented")))
    words = looked.select(F.col("_bucket").alias("_of"), "_tok", said.alias("said"))
    schema = df.select(*keys, F.lit("").alias("annotated")).schema
    run = _annotated(keys, same_letters(df, letters))
    return dealt.groupBy("_bucket").cogroup(words.groupBy("_of")).applyInArrow(run, schema)


Annotator = Callable[[DataFrame], DataFrame]


def dictionary_annotator(dictionary: DataFrame, keys: Sequence[str], text: str = "text", letters: str = CYRILLIC) -> Annotator:
    """An annotation strategy; any ``DataFrame -> DataFrame`` may take its place."""
    return lambda df: annotate_stress(df, dictionary, keys, text, letters)


def term_weights(df: DataFrame, text: str = "text") -> DataFrame:
    """Usage count and inverse-frequency weight of every term."""
    terms = df.select(F.explode(tr.wer_tokens(F.col(text))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    return counts.withColumn("weight", 1.0 / (1.0 + F.col("uses")))


def _md5_number(*parts: Column) -> Column:
    """The first 32 bits of the digest of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the hashed parts."""
    return _md5_number(*parts).cast("double") / 4294967296.0


def pool_intervals(pools: DataFrame) -> DataFrame:
    """(slot, term, upto, share, total, terms) of pools (slot, term, weight): each term's stretch of its slot's weight.

    Weights count in billionths, so running sums are exact. Terms are in the order of their
    digests, whose leading bits cut a slot of any size into blocks.
    """
    place = _md5_number(F.col("term"))
    share = F.greatest(F.round(F.col("weight") * 1e9).cast("bigint"), F.lit(0))
    terms = pools.where("slot IS NOT NULL AND term IS NOT NULL").groupBy("slot", "term").agg(F.sum("weight").alias("weight"))
    placed = terms.select("slot", "term", place.alias("place"), F.shiftright(place, 20).alias("block"), share.alias("share")).where("share > 0")
    placed = kept(placed, "pool")
    upto = prefix(placed.withColumn("upto", F.col("share")), ["slot"], ["place", "term"], "block", {"upto": F.col("share")})
    totals = placed.groupBy("slot").agg(F.sum("share").alias("total"), F.count(F.lit(1)).alias("terms"))
    return upto.join(totals, "slot").select("slot", "term", "upto", "share", "total", "terms")


def weighted_pick(draws: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """Draws (slot, u, ...) with the term of their slot whose running weight first reaches u x total; null without a pool.

    A slot's weight is cut into as many equal cells as it has terms. A term is entered in each
    cell that it touches, at most two a term on average, and a draw meets the terms of its own
    cell; so large pools are joined by equality, and every cell gets its share of the draws.
    """
    cells = kept(intervals, "intervals")
    sizes = small_or_plain(cells.groupBy("slot").agg(F.first("total").alias("_total"), F.first("terms").alias("_terms")))
    cell = lambda at, total, terms: F.least(F.floor(at / (total / terms)), terms - 1)
    low = F.col("upto") - F.col("share")
    entered = cells.select(
        F.col("slot").alias("_slot"),
        F.col("term").alias(name),
        low.alias("_low"),
        F.col("upto").alias("_upto"),
        F.explode(F.sequence(cell(low, F.col("total"), F.col("terms")), cell(F.col("upto"), F.col("total"), F.col("terms")))).alias("_at"),
    )
    aimed = draws.join(sizes, "slot", "left").withColumn("_aim", F.col("u") * F.col("_total"))
    aimed = aimed.withColumn("_cell", cell(F.col("_aim"), F.col("_total"), F.col("_terms")))
    hit = (F.col("_aim") <= F.col("_upto")) & ((F.col("_aim") > F.col("_low")) | ((F.col("_aim") == 0) & (F.col("_low") == 0)))
    met = (F.col("slot") == F.col("_slot")) & (F.col("_cell") == F.col("_at")) & hit
    return aimed.join(entered, met, "left").select(*draws.columns, name)


@F.pandas_udf(StringType())
def _inserted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Texts from their sentences and what is inserted: slot, sentence, clause and term of each."""
    closing = re.compile(r"[.!?]+\Z")

    def one(sentences, slots, places, clauses, terms) -> str | None:
        if sentences is None:
            return None
        said = list(sentences)
        if slots is None:
            return " ".join(said)
        mids: dict[int, list[tuple[int, str]]] = {}
        tails: list[tuple[int, str]] = []
        for slot, i, k, term in zip(slots, places, clauses, terms):
            if slot == "prefix":
                said[i] = f"{term} {said[i]}"
            elif slot == "mid":
                mids.setdefault(i, []).append((k, term))
            else:
                tails.append((i, term))
        for i, inserts in mids.items():
            parts = said[i].split(",")
            for k, term in inserts:
                parts[k] = f" {term},{parts[k]}"
            said[i] = ",".join(parts)
        for i, term in tails:
            end = closing.search(said[i])
            said[i] = f"{said[i][: end.start()]}{term}{end[0]}" if end else f"{said[i]}{term}."
        return " ".join(said)

    for batch in batches:
        yield pd.Series([one(*row) for row in zip(*batch)], dtype="object")


def augment_sentences(df: DataFrame, pools: DataFrame, probability: float, row_id: str, seed: int = 0, text: str = "text") -> DataFrame:
    """Seeded insertions before, between the clauses of, and after each sentence.

    ``pools(slot, term, weight)`` has the terms of the slots prefix, mid and suffix, of any
    number; ``term_weights`` gives the inverse-frequency weights. Whether and what to insert
    follows from the row id, the place and the seed. Sentences are scored once; only draws that
    insert something, and never the sentences, go to the pools, and each text moves once, to
    what its own draws picked. A slot without terms inserts nothing; a null text stays null.
    """
    rows = kept(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    intervals = kept(pool_intervals(pools), "weights")
    k = F.col("_k")

    def picked(places: DataFrame) -> DataFrame:
        """Terms for the places of a sentence: _k is -1 before it, 0 after it, else the clause."""
        slot = F.when(k == -1, "prefix").when(k == 0, "suffix").otherwise("mid")
        asks = places.withColumn("slot", slot)
        key = [F.col(row_id).cast("string"), F.concat(F.lit(f"{seed}|"), "slot"), F.col("_i").cast("string"), F.when(k > 0, k.cast("string"))]
        chance = F.when(k == -1, F.col("_lead")).when(k == 0, F.col("_tail")).otherwise(F.col("_mid"))
        hits = asks.where(uniform(*key, F.lit("p")) < probability * chance).withColumn("u", uniform(*key, F.lit("w")))
        hits = hits.select("slot", "u", "_row", row_id, "_i", "_k", "_mid", "_commas")
        return weighted_pick(hits, intervals, "term").where("term IS NOT NULL")

    said = rows.select("_row", row_id, F.posexplode(tr.sentences(F.col(text))).alias("_i", "_s"))
    scored = said.withColumn("_p", tr.placement_scores(F.col("_s"))).withColumn("_commas", F.size(F.split("_s", ",", -1)) - 1)
    chances = [F.col(f"_p.{c}").alias(n) for c, n in (("prefix", "_lead"), ("mid", "_mid"), ("suffix", "_tail"))]
    picks = picked(scored.select("_row", row_id, "_i", *chances, "_commas", F.explode(F.sequence(F.lit(-1), F.col("_commas"))).alias("_k")))
    if intervals.where("slot = 'prefix' AND contains(term, ',')").limit(1).count():
        # the commas of what was put in front make more clauses
        picks = kept(picks, "picks")
        last = F.col("_commas") + F.size(F.split("term", ",", -1)) - 1
        led = picks.where("slot = 'prefix' AND contains(term, ',')").withColumn("_k", F.explode(F.sequence(F.col("_commas") + 1, last)))
        picks = picks.unionByName(picked(led.drop("slot", "u", "term").withColumns({"_lead": F.lit(0.0), "_tail": F.lit(0.0)})))
    fields = ("slot", "_i", "_k", "term")
    found = picks.groupBy("_row").agg(F.collect_list(F.struct(*fields)).alias("_picks"))
    whole = _inserted(tr.sentences(F.col(text)), *[F.col(f"_picks.{f}") for f in fields])
    return rows.join(found, "_row", "left").select(*df.columns, whole.alias("augmented"))


AXES = ("arousal", "dominance", "valence")


def personas(df: DataFrame, extra: dict[str, tuple] | None = None) -> DataFrame:
    """Persona dimension: anchor and weight per axis."""
    rows = []
    for name, axes in {**tables.PERSONAS, **(extra or {})}.items():
        rows.append((name, *[v for rest, reacts in axes for v in (tables.REST[rest], tables.REACTS[reacts])]))
    fields = ", ".join(f"{a}_anchor double, {a}_weight double" for a in AXES)
    return literal_rows(df, rows, f"persona string, {fields}")


def persona_reaction(df: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Input emotion through the persona; unknown personas mirror it."""
    dim = small_or_plain(dimension) if dimension is not None else F.broadcast(personas(df))
    joined = df.join(dim, "persona", "left")
    for axis, (rest, reacts) in zip(AXES, tables.PERSONA_DEFAULT):
        anchor = F.coalesce(f"{axis}_anchor", F.lit(tables.REST[rest]))
        weight = F.coalesce(f"{axis}_weight", F.lit(tables.REACTS[reacts]))
        joined = joined.withColumn(axis, clamp(anchor + (F.col(axis) - 0.5) * weight, 0.0, 1.0))
    return joined.select(*df.columns)


def arc_phase(index: Column, total: Column) -> Column:
    share = index / (total - 1)
    out = F.when(total <= 1, "climax")
    for upper, name, *_ in tables.ARC_PHASES[:-1]:
        out = out.when(share < upper, name)
    return out.otherwise(tables.ARC_PHASES[-1][1])


def _factors(name: Column, rows: list[tuple[str, list[float], list[str]]]) -> Column:
    """Per-axis (factor, cap) of a named rule; names without a rule change nothing."""

    def entry(factors: list[float], caps: list[str]) -> Column:
        cells = [(a, f, 1.0 if a in caps else float("inf")) for a, f in zip(AXES, factors)]
        return F.struct(*[F.struct(F.lit(f).alias("factor"), F.lit(c).alias("cap")).alias(a) for a, f, c in cells])

    out = None
    for rule, factors, caps in rows:
        out = F.when(name == rule, entry(factors, caps)) if out is None else out.when(name == rule, entry(factors, caps))
    return out.otherwise(entry([1.0, 1.0, 1.0], []))


def paint_strokes(strokes: DataFrame, index: str = "stroke_idx", total: str = "n_strokes") -> DataFrame:
    """Bend the base emotion by arc phase, then nudge it by the delimiter."""
    phases = [(n, list(f), [a for p, a in tables.ARC_CAPPED if p == n]) for _, n, *f in tables.ARC_PHASES]
    nudges = [(n, rest[:3], rest[3]) for n, *rest in tables.DELIMITER_NUDGES]
    out = strokes.withColumn("phase", arc_phase(F.col(index), F.col(total)))
    out = out.withColumn("_p", _factors(F.col("phase"), phases)).withColumn("_n", _factors(F.col("delimiter"), nudges))
    for axis in AXES:
        bent = F.least(F.col(axis) * F.col(f"_p.{axis}.factor"), F.col(f"_p.{axis}.cap"))
        nudged = F.least(bent * F.col(f"_n.{axis}.factor"), F.col(f"_n.{axis}.cap"))
        out = out.withColumn(axis, nudged)
    return out.drop("_p", "_n")


def arc_parameters(arousal: Column, dominance: Column, valence: Column) -> tuple[Column, Column, Column]:
    return 0.3 + arousal * 1.4, 0.6 - dominance * 0.5, 0.3 + valence


def tone_parameters(arousal: Column, dominance: Column, valence: Column) -> tuple[Column, Column, Column]:
    return 0.3 + arousal * 1.2, 0.6 - dominance * 0.4, 0.4 + valence * 0.8


def blend(audio: Column, text: Column) -> Column:
    """Audio sets the baseline, text weighs more."""
    return audio * 0.3 + text * 0.7


def label_clips(clips: DataFrame, transcripts: DataFrame, key: str = "clip", text: str = "text", required: bool = False) -> DataFrame:
    """Clips with a non-empty transcript; if one is ``required``, none at all is an error."""
    found = clips.join(transcripts.filter(F.col(text).isNotNull() & (F.col(text) != "")), key)
    if not required:
        return found
    some = found.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    fault = F.when(F.col("_n") == 0, F.raise_error(F.lit("no clip has a transcript")).cast("boolean"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields]
    return found.unionByName(some.where(F.coalesce(fault, F.lit(False))).select(*nothing))


def unlabelled_clips(clips: DataFrame, transcripts: DataFrame, key: str = "clip", text: str = "text") -> DataFrame:
    """Clips without a usable transcript."""
    return clips.join(transcripts.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(key), key, "left_anti")
