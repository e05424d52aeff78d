"""Text and JSON sources, and the tables written back.

Every reader has a fixed schema; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import tables
from voxframe.functions.textrules import strip
from voxframe.operators.compare import default_on_empty, literal_rows
from voxframe.operators.recursions import kept

TIMELINE = (
    "_source string, _model string, total_duration_s double, "
    "words array<struct<word string, start_s double, end_s double, confidence double>>, "
    "pauses array<struct<after_word string, start_s double, end_s double, duration_s double>>"
)
TARGET = (
    "temporal struct<duration_secs double, speech_rate double, pause_count double, mean_pause_duration double>, "
    "spectral struct<rms_db double, crest_factor double, brightness_hz double, tone_purity double, "
    "zero_crossing_rate double, bass_balance_db double, vocal_darkness_db_oct double, vocal_weight_hz double>, "
    "voice struct<pitch_hz double, pitch_variation_hz double, voice_presence double, breathiness_db double>"
)
# Target fields behind the gap metrics.
TARGET_FIELDS = [
    ("Loudness", "spectral.rms_db"),
    ("Dynamic range", "spectral.crest_factor"),
    ("Brightness", "spectral.brightness_hz"),
    ("Tone purity", "spectral.tone_purity"),
    ("Noise texture", "spectral.zero_crossing_rate"),
    ("Duration", "temporal.duration_secs"),
    ("Speech rate", "temporal.speech_rate"),
    ("Voice presence", "voice.voice_presence"),
    ("Pitch variation", "voice.pitch_variation_hz"),
    ("Bass balance", "spectral.bass_balance_db"),
    ("Vocal darkness", "spectral.vocal_darkness_db_oct"),
    ("Vocal weight", "spectral.vocal_weight_hz"),
    ("Breathiness", "voice.breathiness_db"),
]
LEGACY_TARGET = (
    "voice struct<f0MeanHz double, f0StdDevHz double, voicedRatio double, hnrDbMean double, cppMean double, jitter double, shimmer double>, "
    "spectral struct<rmsDb double, spectralSlope double, spectralTilt double, crestFactor double, presenceRatio double, "
    "hfRatio double, lfRatio double, noiseFloorRatio double>"
)
# The metrics the legacy form shares with the current one.
LEGACY_FIELDS = [
    ("Loudness", "spectral.rmsDb"),
    ("Dynamic range", "spectral.crestFactor"),
    ("Voice presence", "voice.voicedRatio"),
    ("Pitch variation", "voice.f0StdDevHz"),
]
GAP_SNAPSHOT = "timestamp string, meanGapPct double, phraseGaps array<struct<phrase string, gapPct double>>"
MANIFEST = "title string, voice string, model string, beats array<struct<shade string, text string>>"
PRESETS = "array<struct<name string, opts map<string, double>>>"
SESSION_FILE = (
    "phrase string, model string, saved_at string, "
    "tracks array<struct<label string, rating int, winner boolean, note string, opts map<string, double>, gap_pct double>>"
)
RECEIPT = (
    "timestamp string, text_preview string, text_chars bigint, audio_duration_sec double, rtt_ms bigint, "
    "cache_hit boolean, gpu_sec double, cost_usd double"
)


def line_order() -> Column:
    """Where a row of a text or CSV scan stands: its file, the split's place in the file, the row's place in the split.

    Rows of one split are read in order by one task, so its row counter rises along them; the
    numbers of tasks and the order of splits among them have no part in it. To be selected
    right at the scan.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files, counted from zero in each file.

    Two passes: lines of each split are counted, then numbered on from the splits before it in
    the file. No file is held or sorted as a whole.
    """
    lines = kept(spark.read.text(path).select(line_order().alias("_at"), "value").select("_at.*", "value"), "lines")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    splits = splits.select("file", "start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(splits, ["file", "start"]).select("file", (F.col("_before") + F.col("row") - F.col("_first")).alias("line_no"), "value")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def parse_json(docs: DataFrame, schema: str, keys: Sequence[str], column: str = "value") -> DataFrame:
    """JSON texts of a column as rows of a fixed schema, with their keys; what cannot be read gives nulls."""
    return docs.select(*keys, F.from_json(column, schema).alias("_doc")).select(*keys, "_doc.*")


def parse_transcripts(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """``clip|text`` lines; split at the first pipe, the last duplicate wins."""
    piped = lines.filter(F.col(line).contains("|"))
    parts = F.split(line, r"\|", 2)
    pairs = piped.select(strip(parts[0]).alias("clip"), strip(parts[1]).alias("text"), order)
    return pairs.groupBy("clip").agg(F.max_by("text", order).alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript manifests; later lines win, of several files those of the last by path."""
    lines = numbered_lines(spark, path)
    return parse_transcripts(lines.select(F.struct("file", "line_no").alias("line_no"), "value"))


def timeline_rows(doc: DataFrame, keys: Sequence[str] = ("file",)) -> tuple[DataFrame, DataFrame]:
    """Words and pauses of parsed timelines, one row each."""
    words = doc.select(*keys, F.posexplode("words").alias("ordinal", "w")).select(*keys, "ordinal", "w.*")
    pauses = doc.select(*keys, F.posexplode("pauses").alias("ordinal", "p")).select(*keys, "ordinal", "p.*")
    return words, pauses


def read_timeline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reference words and pauses, one row each."""
    return timeline_rows(_json(spark, path, TIMELINE))


def _long(doc: DataFrame, fields: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(f, F.lit(0.0)).alias("target")) for m, f in fields])
    return doc.select(*keys, F.inline(rows))


def target_rows(doc: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Metric targets in long form; a missing field is 0."""
    return _long(doc, TARGET_FIELDS, keys)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return target_rows(_json(spark, path, TARGET))


def read_legacy_targets(spark: SparkSession, path: str) -> DataFrame:
    return _long(_json(spark, path, LEGACY_TARGET), LEGACY_FIELDS, ["file"])


def snapshot_rows(doc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    gaps = doc.select(*keys, "timestamp", F.col("meanGapPct").alias("mean_gap_pct"), F.inline("phraseGaps"))
    return gaps.withColumnRenamed("gapPct", "gap_pct")


def read_gap_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return snapshot_rows(_json(spark, path, GAP_SNAPSHOT))


def manifest_rows(doc: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Beats of parsed manifests; the voice is English unless one is named."""
    beats = doc.select(*keys, "title", F.coalesce("voice", F.lit("en")).alias("voice"), "model", F.posexplode("beats").alias("idx", "b"))
    return beats.select(*keys, "title", "voice", "model", "idx", "b.shade", "b.text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(_json(spark, path, MANIFEST))


def parse_presets(docs: DataFrame, column: str = "value") -> DataFrame:
    """Named presets of JSON arrays; the built-in four when nothing can be read."""
    rows = docs.select(F.inline(F.from_json(column, PRESETS))).filter("name IS NOT NULL")
    defaults = literal_rows(docs, tables.DEFAULT_PRESETS, "name string, opts map<string, double>")
    return default_on_empty(rows, defaults)


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    return parse_presets(spark.read.option("wholetext", True).text(path))


# Columns of a stress dictionary that hold word forms.
FORM_COLUMNS = [
    "bare", "accented",
    "sg_nom", "sg_gen", "sg_dat", "sg_acc", "sg_inst", "sg_prep",
    "pl_nom", "pl_gen", "pl_dat", "pl_acc", "pl_inst", "pl_prep",
    "past_m", "past_f", "past_n", "past_pl",
    "presfut_sg1", "presfut_sg2", "presfut_sg3", "presfut_pl1", "presfut_pl2", "presfut_pl3",
    "imperative_sg", "imperative_pl",
    "short_m", "short_f", "short_n", "short_pl",
    "comparative",
]


def stress_pairs(forms: DataFrame, order: str = "line_no", mark: str = "'") -> DataFrame:
    """(bare, accented) from dictionary rows; the first insert of a word wins.

    Only forms that carry the stress mark count; ``-`` and blanks are skipped.
    """
    present = [c for c in FORM_COLUMNS if c in forms.columns]
    lemma = F.struct(F.trim(forms.columns[0]).alias("bare"), F.trim(forms.columns[1]).alias("form"))
    inflected = [F.struct(F.replace(F.trim(c), F.lit(mark), F.lit("")).alias("bare"), F.trim(c).alias("form")) for c in present]
    rows = forms.select(order, F.posexplode(F.array(lemma, *inflected)).alias("_at", "p"))
    used = rows.filter(F.col("p.form").contains(mark) & ~F.col("p.form").isin("", "-"))
    return used.groupBy(F.lower("p.bare").alias("bare")).agg(
        F.min_by(F.replace(F.col("p.form"), F.lit(mark), F.lit("́")), F.struct(order, "_at")).alias("accented")
    )


def read_stress(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Stress dictionaries in load order, as tab-separated files with a header; the first insert of a word wins.

    The order of inserts is that of the paths given, then of a path's files by name, then of
    lines, however the files are split.
    """
    out = None
    for load, path in enumerate(paths):
        rows = spark.read.option("sep", "\t").option("header", True).csv(path)
        placed = rows.select("*", line_order().alias("line_no"))
        pairs = stress_pairs(placed).withColumn("load", F.lit(load))
        out = pairs if out is None else out.unionByName(pairs)
    return out.groupBy("bare").agg(F.min_by("accented", "load").alias("accented"))


def lexicon(df: DataFrame, rows: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Word pools as (pool, position, term, ord) rows."""
    return literal_rows(df, rows, "pool string, position string, term string, ord int")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("file", F.input_file_name())


def track_rows(doc: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    tracks = doc.select(*keys, "phrase", "model", "saved_at", F.posexplode("tracks").alias("track_no", "t"))
    return tracks.select(*keys, "phrase", "model", "saved_at", "track_no", "t.*")


def read_session_tracks(spark: SparkSession, path: str) -> DataFrame:
    return track_rows(_json(spark, path, SESSION_FILE))


def append_ledger(receipts: DataFrame, path: str) -> None:
    """Append receipts, one folder per day."""
    receipts.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def write_snapshot(scores: DataFrame, path: str) -> None:
    """Store a snapshot; only the models present are replaced."""
    (
        scores.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


# Number formats of the exported feature matrix.
FEATURE_FORMATS = [
    ("exaggeration", "exagg", 2),
    ("cfg_weight", "cfg", 2),
    ("temperature", "temp", 2),
    ("pitch_var_hz", "pitch_var", 1),
    ("rms_db", "rms", 1),
    ("speech_rate", "rate", 1),
    ("crest_db", "crest", 1),
    ("duration_secs", "duration", 2),
]


def feature_matrix(samples: DataFrame) -> DataFrame:
    return samples.select(*[F.format_string(f"%.{d}f", F.col(c)).alias(n) for c, n, d in FEATURE_FORMATS])


def write_features(samples: DataFrame, path: str) -> None:
    feature_matrix(samples).write.mode("overwrite").option("header", True).csv(path)


def dataset_counters(clips: DataFrame, transcripts: DataFrame, max_s: float | None = None) -> DataFrame:
    """Files, matched files, kept files and minutes of a corpus.

    ``clips(clip, duration_s)``; a clip matches when it has a transcript.
    """
    known = transcripts.filter("text <> ''").select("clip", F.lit(True).alias("_m"))
    joined = clips.join(known, "clip", "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    kept = F.col("_m") & (F.lit(True) if max_s is None else F.col("duration_s") <= max_s)
    return joined.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("_m").alias("matched"),
        F.count_if(kept).alias("kept"),
        F.coalesce(F.sum(F.when(kept, F.col("duration_s"))) / 60.0, F.lit(0.0)).alias("minutes"),
    )
