"""Sources, sinks and hooks over the given tables: JSON texts written from them are parsed back, tables are appended and replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxframe.functions import scalar, tables
from voxframe.functions.scalar import rnd
from voxframe.operators import compare, sessions
from voxframe.operators import text as ops
from voxframe.plans.registry import ORACLES, query, rnd_sql as r, table, with_sql
from voxframe.plans.trials import _KNOBS, measured_knobs
from voxframe.session import shared_dir
from voxframe.sources import files

_WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


def _timelines(spark, sf):
    """A word and pause timeline of each conversation turn, as JSON text: a word takes a second, a pause follows a full stop."""
    turns = table(spark, sf, "conversations").where("text IS NOT NULL")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    at = lambda i: i.cast("double")
    said = F.transform(words, lambda w, i: F.struct(w.alias("word"), at(i).alias("start_s"), (at(i) + 0.75).alias("end_s"), F.lit(0.5).alias("confidence"), i.alias("i")))
    ends = F.filter(said, lambda s: s["word"].endswith("."))
    pauses = F.transform(ends, lambda s: F.struct(s["word"].alias("after_word"), s["end_s"].alias("start_s"), (s["end_s"] + 0.25).alias("end_s"), F.lit(0.25).alias("duration_s")))
    doc = F.to_json(F.struct(F.size(said).cast("double").alias("total_duration_s"), said.alias("words"), pauses.alias("pauses")))
    docs = turns.select("conv_id", "turn", doc.alias("value"))
    return files.timeline_rows(files.parse_json(docs, files.TIMELINE, ["conv_id", "turn"]), ["conv_id", "turn"])


@query(
    "timeline_words",
    f"SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS ordinal, word, (i - 1)::DOUBLE AS start_s, i - 0.25::DOUBLE AS end_s FROM (SELECT conv_id, turn, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM conversations)",
)
def timeline_words(spark, sf):
    return _timelines(spark, sf)[0].select("conv_id", "turn", F.col("ordinal").cast("bigint").alias("ordinal"), "word", "start_s", "end_s")


@query(
    "timeline_pauses",
    f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS ordinal, word AS after_word, i - 0.25::DOUBLE AS start_s FROM (SELECT conv_id, turn, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM conversations) WHERE word LIKE '%.'",
)
def timeline_pauses(spark, sf):
    return _timelines(spark, sf)[1].select("conv_id", "turn", F.col("ordinal").cast("bigint").alias("ordinal"), "after_word", "start_s")


_TARGET_SQL = ", ".join(
    f"{{'metric': '{m}', 'target': {'s_acctbal::DOUBLE' if f == 'temporal.duration_secs' else 's_suppkey::DOUBLE' if f == 'spectral.rms_db' else 's_nationkey::DOUBLE' if f == 'voice.voice_presence' else '0::DOUBLE'}}}"
    for m, f in files.TARGET_FIELDS
)


@query("target_rows", f"SELECT s_suppkey, t.metric AS metric, {r('t.target', 4)} AS target FROM (SELECT s_suppkey, unnest([{_TARGET_SQL}]) AS t FROM supplier)")
def target_rows(spark, sf):
    """Targets with missing fields and sections, which count as 0."""
    doc = F.to_json(
        F.struct(
            F.struct(F.col("s_acctbal").cast("double").alias("duration_secs")).alias("temporal"),
            F.struct(F.col("s_suppkey").cast("double").alias("rms_db"), F.lit("x").alias("unknown")).alias("spectral"),
            F.struct(F.col("s_nationkey").cast("double").alias("voice_presence")).alias("voice"),
        )
    )
    docs = table(spark, sf, "supplier").select("s_suppkey", doc.alias("value"))
    out = files.target_rows(files.parse_json(docs, files.TARGET, ["s_suppkey"]), ["s_suppkey"])
    return out.withColumn("target", rnd(F.col("target"), 4))


@query(
    "manifest_beats",
    "SELECT doc_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'en' END AS voice, CAST(i - 1 AS BIGINT) AS idx, 'hot' AS shade, line AS text FROM "
    "(SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)",
)
def manifest_beats(spark, sf):
    """Every line of a document as a beat; odd documents name no voice."""
    beats = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("hot").alias("shade"), x.alias("text")))
    voice = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(F.col("source").alias("title"), voice.alias("voice"), beats.alias("beats"))).alias("value"))
    out = files.manifest_rows(files.parse_json(docs, files.MANIFEST, ["doc_id"]), ["doc_id"])
    return out.select("doc_id", "title", "voice", F.col("idx").cast("bigint").alias("idx"), "shade", "text")


@query("parsed_presets", f"SELECT p_name AS name, {r('p_retailprice / 1000', 6)} AS exaggeration FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0")
def parsed_presets(spark, sf):
    """Preset lists with nameless entries and texts that are no JSON."""
    name = F.when(F.col("p_partkey") % 5 > 0, F.col("p_name"))
    good = F.to_json(F.array(F.struct(name.alias("name"), F.struct((F.col("p_retailprice") / 1000).cast("double").alias("exaggeration")).alias("opts"))))
    docs = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 7 > 0, good).otherwise("[{broken").alias("value"))
    return files.parse_presets(docs).select("name", rnd(F.element_at("opts", "exaggeration"), 6).alias("exaggeration"))


@query("default_presets", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 1")
def default_presets(spark, sf):
    """Rows of a source that has none are those of its fallback."""
    parts = table(spark, sf, "part").select("p_partkey")
    return compare.default_on_empty(parts.where("p_partkey < 0"), parts.where("p_partkey % 3 = 1"))


@query(
    "session_tracks",
    f"SELECT c_custkey, c_name AS phrase, c_mktsegment AS model, CAST(k AS BIGINT) AS track_no, 't' || k AS label, CAST(c_custkey % 5 + k AS INT) AS rating, k = 1 AS winner, {r('c_acctbal + k', 2)} AS gap_pct FROM customer, (SELECT unnest([0, 1, 2]) AS k)",
)
def session_tracks(spark, sf):
    track = lambda k: F.struct(F.lit(f"t{k}").alias("label"), (F.col("c_custkey") % 5 + k).alias("rating"), F.lit(k == 1).alias("winner"), (F.col("c_acctbal") + k).cast("double").alias("gap_pct"))
    doc = F.to_json(F.struct(F.col("c_name").alias("phrase"), F.col("c_mktsegment").alias("model"), F.array(*map(track, range(3))).alias("tracks")))
    docs = table(spark, sf, "customer").select("c_custkey", doc.alias("value"))
    out = files.track_rows(files.parse_json(docs, files.SESSION_FILE, ["c_custkey"]), ["c_custkey"])
    return out.select("c_custkey", "phrase", "model", F.col("track_no").cast("bigint").alias("track_no"), "label", "rating", "winner", rnd(F.col("gap_pct"), 2).alias("gap_pct"))


@query("appended_ledger", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS calls, {r('sum(value / 10)', 3)} AS audio_sec FROM events GROUP BY CAST(ts AS DATE)")
def appended_ledger(spark, sf):
    """Receipts appended in two runs and read back by day."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    calls = table(spark, sf, "events").select("event_id", "ts", (F.col("value") / 10).alias("audio_duration_sec"), F.lit(False).alias("cache_hit"), F.lit("x").alias("text"))
    for part in (0, 1):
        files.append_ledger(sessions.receipts(calls.where(F.col("event_id") % 2 == part)), path)
    days = spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("calls"), rnd(F.sum("audio_duration_sec"), 3).alias("audio_sec"))
    return days.withColumn("date", F.col("date").cast("string"))


@query(
    "replaced_snapshot",
    "SELECT p_brand AS model, CASE WHEN p_brand < 'Brand#2' THEN 2 ELSE 1 END AS run, count(*) AS n FROM part GROUP BY p_brand",
)
def replaced_snapshot(spark, sf):
    """A second snapshot replaces the models that it has and leaves the others."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    scores = table(spark, sf, "part").select(F.col("p_brand").alias("model"), "p_partkey")
    files.write_snapshot(scores.withColumn("run", F.lit(1)), path)
    files.write_snapshot(scores.where("model < 'Brand#2'").withColumn("run", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("model", "run").agg(F.count(F.lit(1)).alias("n"))


_FEATURES = {"exaggeration": "l_discount", "cfg_weight": "l_tax", "temperature": "l_quantity", "pitch_var_hz": "l_quantity", "rms_db": "l_quantity", "speech_rate": "l_linenumber", "crest_db": "l_tax", "duration_secs": "l_discount"}


@query(
    "feature_matrix",
    "SELECT " + ", ".join(f"printf('%.{d}f', {_FEATURES[c]}::DOUBLE) AS {n}" for c, n, d in files.FEATURE_FORMATS) + " FROM lineitem",
)
def feature_matrix(spark, sf):
    """The feature matrix written as CSV and read back."""
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    files.write_features(table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(n) for n, c in _FEATURES.items()]), path)
    schema = ", ".join(f"{n} string" for _, n, _ in files.FEATURE_FORMATS)
    return spark.read.schema(schema).option("header", True).csv(path)


@query(
    "scale_helpers",
    f"SELECT event_id, {r('CASE WHEN value > 0 THEN 20 * log10(value) END', 6)} AS level_db, {r('2595.0::DOUBLE * log10(1.0::DOUBLE + value / 700.0)', 6)} AS mel, {r('value', 6)} AS hz, [round(value * i / 4 * 1e6) / 1e6 for i in [0, 1, 2, 3, 4]] AS steps FROM events WHERE value > 0",
)
def scale_helpers(spark, sf):
    """Decibels, mel and back, and evenly spaced steps."""
    x = F.col("value")
    steps = F.transform(scalar.linspace(F.lit(0.0), x, 5), lambda v: F.round(v * 1e6) / 1e6)
    return table(spark, sf, "events").where("value > 0").select(
        "event_id", rnd(scalar.db(x), 6).alias("level_db"), rnd(scalar.hz_to_mel(x), 6).alias("mel"), rnd(scalar.mel_to_hz(scalar.hz_to_mel(x)), 6).alias("hz"), steps.alias("steps")
    )


@query(
    "own_metric",
    with_sql(
        {"m": "SELECT p_partkey AS series_id, p_size::DOUBLE AS value FROM part"},
        f"SELECT series_id, {r('least(100.0, abs(value - 20) / 40.0 * 100)', 4)} AS gap_pct FROM m",
    ),
)
def own_metric(spark, sf):
    """A metric that the registry does not have is a row more of it."""
    metrics = table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"), F.lit("Size").alias("metric"), F.col("p_size").cast("double").alias("value"))
    definitions = compare.metric_definitions(metrics, [("Size", "cm", 40.0)])
    targets = compare.literal_rows(metrics, [("Size", 20.0)], "metric string, target double")
    return compare.gap_table(metrics, targets, definitions).select("series_id", rnd(F.col("gap_pct"), 4).alias("gap_pct"))


@query(
    "own_annotator",
    "SELECT conv_id, turn, text || ' (' || length(text) || ')' AS annotated FROM conversations WHERE text IS NOT NULL",
)
def own_annotator(spark, sf):
    """An annotation strategy is any function of a table; this one notes the length."""

    def strategy(df):
        return df.withColumn("annotated", F.concat("text", F.lit(" ("), F.char_length("text").cast("string"), F.lit(")")))

    annotate: ops.Annotator = strategy
    return annotate(table(spark, sf, "conversations").where("text IS NOT NULL")).select("conv_id", "turn", "annotated")


@query(
    "own_policy",
    "WITH base AS ("
    + ORACLES["correct_knobs"]
    + "), m AS (SELECT l_partkey, -avg(l_quantity) / 2 AS loudness_db FROM lineitem GROUP BY l_partkey) "
    + f"SELECT l_partkey, {r('CASE WHEN {0} - loudness_db > 0 THEN {1}::DOUBLE + 1 ELSE new_presence_db END', 5)} AS new_presence_db FROM base JOIN m USING (l_partkey)".format(
        tables.CONTROLLER["targets"]["loudness_db"], _KNOBS["presence_db"]
    ),
)
def own_policy(spark, sf):
    """A policy raises the presence of quiet takes; elsewhere it has no say and the built-in rule applies."""
    policy = lambda err, knobs: {"presence_db": F.when(err["loudness_db"] > 0, knobs["presence_db"] + 1.0)}
    out = compare.correct_knobs(measured_knobs(spark, sf), policy=policy)
    return out.select("l_partkey", rnd(F.col("new_presence_db"), 5).alias("new_presence_db"))


@query(
    "own_palette",
    f"SELECT s_suppkey AS beat, {r('CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE n_nationkey / 25.0 END', 4)} AS exaggeration, {r('CASE WHEN s_suppkey % 3 = 0 THEN 0.8 ELSE 0.25 END', 4)} AS temperature FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def own_palette(spark, sf):
    """Nations as a palette of shades; a shade that it does not have takes the defaults."""
    nations = table(spark, sf, "nation")
    shades = nations.select(F.lower("n_name").alias("shade"), (F.col("n_nationkey") / 25.0).alias("exaggeration"), F.lit(0.5).alias("cfg_weight"), F.lit(0.25).alias("temperature"))
    named = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    beats = named.select(F.col("s_suppkey").alias("beat"), F.when(F.col("s_suppkey") % 3 == 0, "no such shade").otherwise(F.col("n_name")).alias("shade"))
    out = ops.resolve_shades(beats, shades)
    return out.select("beat", rnd(F.col("exaggeration"), 4).alias("exaggeration"), rnd(F.col("temperature"), 4).alias("temperature"))
