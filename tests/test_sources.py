import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import kernels
from voxframe.operators import compare, signal
from voxframe.session import shared_dir
from voxframe.sources import audio, files

RATE = 22050


def sine(hz, seconds, amp=1.0, rate=RATE):
    return amp * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


def silence(seconds, rate=RATE):
    return np.zeros(int(rate * seconds))


def write_wav(path, samples, rate=RATE, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        kind = {2: "<i2", 4: "<i4", 1: "u1"}[width]
        scale = {2: 32767, 4: 2**31 - 1, 1: 100}[width]
        w.writeframes((np.repeat(samples, channels) * scale).astype(kind).tobytes())


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("wav")
    rng = np.random.default_rng(4)
    write_wav(root / "tone440.wav", sine(440, 1))
    write_wav(root / "tone1000.wav", sine(1000, 1))
    write_wav(root / "tone300.wav", sine(300, 1, 0.5))
    write_wav(root / "tone4000.wav", sine(4000, 1, 0.5))
    write_wav(root / "quiet.wav", silence(1))
    write_wav(root / "noise.wav", rng.uniform(-0.5, 0.5, RATE))
    write_wav(root / "gap.wav", np.concatenate([sine(200, 0.5), silence(0.3), sine(200, 0.5)]))
    write_wav(root / "nogap.wav", np.concatenate([sine(200, 0.5), silence(0.05), sine(200, 0.5)]))
    write_wav(root / "edges.wav", np.concatenate([silence(0.3), sine(200, 0.5), silence(0.3)]))
    write_wav(root / "harmonic.wav", sum(sine(150 * k, 1, 0.3 / k) for k in range(1, 6)))
    write_wav(root / "stereo.wav", sine(440, 0.5, 0.5), channels=2, width=4)
    write_wav(root / "shallow.wav", sine(440, 0.5, 0.5), width=1)
    (root / "broken.wav").write_bytes(b"not audio")
    (root / "notes.txt").write_text("skip me")
    return str(root)


def rows(df, key="clip_id"):
    return {r[key]: r for r in df.collect()}


def test_scan_counts_rejects(spark, corpus):
    got = rows(audio.scan_clips(spark, corpus))
    assert len(got) == 13
    assert {k for k, r in got.items() if r.reject} == {"broken", "shallow"}
    assert got["tone440"].duration_s == pytest.approx(1.0) and got["stereo"].sample_rate == RATE


def test_levels_and_loudness(spark, corpus):
    samples = audio.frame_table(spark, corpus, "samples")
    got = rows(signal.loudness(samples, ["clip_id"]))
    assert got["tone440"].rms_db == pytest.approx(-3.01, abs=0.1)
    assert got["quiet"].rms_db == -math.inf and got["quiet"].crest == 0.0
    assert got["stereo"].rms_db == pytest.approx(-9.03, abs=0.1)
    assert "shallow" not in got and "broken" not in got
    zcr = rows(signal.zero_crossing_rate(samples, RATE, ["clip_id"]))
    assert zcr["quiet"].zcr == 0.0 and zcr["tone440"].zcr == pytest.approx(880, abs=3)


def test_envelope_keeps_the_tail(spark, corpus):
    frames = audio.frame_table(spark, corpus, "envelope")
    got = rows(frames.groupBy("clip_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("frames")))
    assert got["tone440"].n == RATE and got["tone440"].frames == math.ceil(RATE / 220)


def test_temporal_and_timeline(spark, corpus):
    levels = audio.frame_table(spark, corpus, "levels").withColumn("block", signal.index_block("frame_idx", 40))
    totals = audio.scan_clips(spark, corpus).filter("reject IS NULL").select("clip_id", F.col("duration_s").alias("total_s"))
    got = rows(signal.temporal_metrics(levels, 0.01, 0.01, keys=["clip_id"], value="rms", totals=totals))
    assert (got["gap"].pause_count, got["nogap"].pause_count, got["edges"].pause_count) == (1, 0, 2)
    assert got["quiet"].speech_rate == 0.0 and got["quiet"].pause_ratio == 1.0
    env = audio.frame_table(spark, corpus, "envelope").filter(f"n = {RATE // 100}").withColumn("block", signal.index_block("frame_idx", 25))
    seg = signal.vad_segments(env, 0.01, 0.01, keys=["clip_id"], value="rms", totals=totals)
    summary = rows(signal.timeline_summary(seg, ["clip_id"]))
    assert summary["edges"].pause_count == 2 and summary["quiet"].silence_ratio == pytest.approx(1.0)
    merged = signal.merge_short_silences(seg, 0.1, ["clip_id"])
    assert merged.filter("clip_id = 'nogap'").count() == 1 and merged.filter("clip_id = 'gap'").count() == 3


def test_spectral(spark, corpus):
    frames = audio.frame_table(spark, corpus, "spectral")
    got = rows(audio.spectral_summary(frames))
    assert got["tone1000"].brightness_hz == pytest.approx(1000, abs=50)
    assert got["tone300"].bass_balance_db > 5 and got["tone4000"].bass_balance_db < -5
    assert got["noise"].tone_purity > 0.5 > got["tone440"].tone_purity
    assert "quiet" not in got
    tilt = rows(audio.tilt_summary(frames))
    assert tilt["harmonic"].vocal_darkness_db_oct < tilt["noise"].vocal_darkness_db_oct
    only = audio.frame_table(spark, corpus, "spectral", keep=["centroid"])
    assert only.columns == ["clip_id", "sample_rate", "frame_idx", "centroid"]


def test_pitch_and_voice(spark, corpus):
    f0 = audio.frame_table(spark, corpus, "pitch").withColumn("block", F.lit(0))
    got = rows(signal.pitch_statistics(f0, F.col("f0") > 0, 512 / RATE, ["clip_id"], value="f0"))
    assert got["tone440"].pitch_hz == pytest.approx(440, rel=0.02) and got["harmonic"].pitch_hz == pytest.approx(150, rel=0.02)
    assert got["noise"].voice_presence < 0.2 and got["quiet"].voice_presence == 0.0
    voice = rows(audio.voice_summary(audio.frame_table(spark, corpus, "voice")))
    assert voice["harmonic"].hnr_db > voice["noise"].hnr_db
    assert voice["harmonic"].breathiness_db > 0 and "quiet" not in voice
    samples = audio.frame_table(spark, corpus, "samples").withColumn("block", signal.index_block("frame_idx", 1000))
    cycles = signal.glottal_cycles(samples, RATE // 500, RATE // 80, 0.01, ["clip_id"])
    assert rows(signal.jitter_shimmer(cycles, ["clip_id"]))["tone440"].jitter < 0.02


def brute_frame(frame, rate):
    """Direct sums of the voice features for one frame."""
    n = len(frame)
    lags = range(rate // 500, min(rate // 80, n - 1) + 1)
    corr = {k: float(np.dot(frame[: n - k], frame[k:])) for k in lags}
    lag = max(lags, key=lambda k: corr[k])
    r0 = float(np.dot(frame, frame))
    t = np.arange(n)
    strength = lambda hz: abs(np.sum(frame * np.exp(-2j * np.pi * hz * t / rate)))
    win = frame * (0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1)))
    half = n // 2
    logs = np.array([np.log(max(abs(np.sum(win * np.exp(-2j * np.pi * k * t / n))) ** 2, 1e-12)) for k in range(half)])
    q = np.arange(half)
    ceps = np.array([np.sum(logs * np.cos(2 * np.pi * q * i / half)) / half for i in range(half)])
    lo, hi = min(rate // 500, half - 1), min(rate // 80, half - 1)
    at = lo + int(np.argmax(ceps[lo : hi + 1]))
    base = ceps[lo] + (ceps[hi] - ceps[lo]) / (hi - lo) * (at - lo)
    return 10 * np.log10(corr[lag] / (r0 - corr[lag])), max(ceps[at] - base, 0.0), 20 * np.log10(strength(rate / lag) / strength(2 * rate / lag))


def test_voice_kernel_matches_direct_sums():
    rate = 16000
    rng = np.random.default_rng(2)
    x = sum(sine(170 * k, 0.2, 0.3 / k, rate) for k in range(1, 5)) + rng.normal(0, 0.02, int(rate * 0.2))
    got = kernels.voice_columns(x, rate)
    size = int(rate * 0.025)
    for i in (0, 3, 9):
        hnr, cpp, breath = brute_frame(x[i * 160 : i * 160 + size], rate)
        assert (got["hnr"][i], got["cpp"][i], got["breathiness"][i]) == pytest.approx((hnr, cpp, breath), rel=1e-6)


def test_distances_of_identical_clips(spark, corpus):
    def sides(family):
        frames = audio.frame_table(spark, corpus, family).filter("clip_id IN ('harmonic', 'noise')")
        same = frames.filter("clip_id = 'harmonic'").select(F.lit("same").alias("pair"), "frame_idx", "vector")
        left = same.unionByName(same.withColumn("pair", F.lit("other")))
        noise = frames.filter("clip_id = 'noise'").select(F.lit("other").alias("pair"), "frame_idx", "vector")
        return compare.frame_pairs(left, same.unionByName(noise), ["pair"])

    mcd = rows(compare.mel_cepstral_distance(sides("mcep"), ["pair"]), "pair")
    assert mcd["same"].mcd < 1e-3 < 1 < mcd["other"].mcd
    lsd = rows(compare.log_spectral_distance(sides("log_mel")).groupBy("pair").agg(F.avg("lsd").alias("lsd")), "pair")
    assert lsd["same"].lsd < 0.1 and lsd["other"].lsd > 5
    vectors = rows(compare.mean_vector(audio.frame_table(spark, corpus, "mfcc"), ["clip_id"], "vector"))
    assert len(vectors["noise"].centroid) == 13


def test_bands(spark, corpus):
    got = rows(audio.frame_table(spark, corpus, "bands"))
    assert got["tone4000"].bright > got["tone300"].bright and got["tone300"].low > got["tone4000"].low
    assert got["tone300"].coarse_centroid < got["tone4000"].coarse_centroid


def test_clean_report_of_audio(spark, corpus):
    samples = audio.frame_table(spark, corpus, "samples")
    got = rows(signal.clean_report(samples, RATE, ["clip_id"], min_s=0.4))
    assert got["edges"].kept and got["edges"].after_s == pytest.approx(0.5, abs=0.01) and got["edges"].before_s == pytest.approx(1.1, abs=0.01)
    assert not got["quiet"].kept and got["quiet"].after_s == 0.0
    totals = signal.clean_totals(signal.clean_report(samples, RATE, ["clip_id"], min_s=0.4)).first()
    assert totals.silent_files == 1 and totals.files == len(got) - 1


# ---- text and JSON


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def dump(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False))
    return str(path)


def test_transcripts(spark, folder):
    (folder / "t.txt").write_text("a.wav | one | two\nno pipe\nb.wav|x\n a.wav |last\n")
    assert {r.clip: r.text for r in files.read_transcripts(spark, str(folder / "t.txt")).collect()} == {"a.wav": "last", "b.wav": "x"}


def test_timeline(spark, folder):
    doc = {
        "_source": "s", "_model": "m", "total_duration_s": 1.0,
        "words": [{"word": "a", "start_s": 0.0, "end_s": 0.4, "confidence": 1.0}, {"word": "b", "start_s": 0.5, "end_s": 0.9, "confidence": 0.9}],
        "pauses": [{"after_word": "a", "start_s": 0.4, "end_s": 0.5, "duration_s": 0.1}],
    }
    words, pauses = files.read_timeline(spark, dump(folder / "t.json", doc))
    assert [r.word for r in words.orderBy("ordinal").collect()] == ["a", "b"] and pauses.first().after_word == "a"


def test_targets(spark, folder):
    new = {"spectral": {"rms_db": -20.0}, "voice": {"voice_presence": 0.5}, "temporal": {}}
    got = rows(files.read_targets(spark, dump(folder / "n.json", new)), "metric")
    assert len(got) == 13 and got["Loudness"].target == -20.0 and got["Breathiness"].target == 0.0
    old = {"voice": {"f0StdDevHz": 30.0, "voicedRatio": 0.6}, "spectral": {"rmsDb": -18.0}}
    legacy = rows(files.read_legacy_targets(spark, dump(folder / "o.json", old)), "metric")
    assert legacy["Loudness"].target == -18.0 and legacy["Pitch variation"].target == 30.0


def test_snapshot_manifest_session(spark, folder):
    snap = {"timestamp": "t", "meanGapPct": 22.6, "phraseGaps": [{"phrase": "p", "gapPct": 20.3}]}
    assert files.read_gap_snapshot(spark, dump(folder / "s.json", snap)).first().gap_pct == 20.3
    beats = {"title": "x", "model": "m", "beats": [{"shade": "warm", "text": "hi"}]}
    assert files.read_manifest(spark, dump(folder / "m.json", beats)).first().voice == "en"
    session = {"phrase": "p", "tracks": [{"label": "a", "rating": 3, "opts": {"x": 1.0}}, {"label": "b", "rating": 5}]}
    assert [r.rating for r in files.read_session_tracks(spark, dump(folder / "q.json", session)).collect()] == [3, 5]


def test_presets(spark, folder):
    good = dump(folder / "p.json", [{"name": "a", "opts": {"x": 1.0}}, {"opts": {}}])
    assert [r.name for r in files.read_presets(spark, good).collect()] == ["a"]
    (folder / "bad.json").write_text("{nope")
    assert {r.name for r in files.read_presets(spark, str(folder / "bad.json")).collect()} == {"baseline", "warm", "punchy", "bright"}


def test_stress_dictionary(spark, folder):
    (folder / "1.tsv").write_text("bare\taccented\tgender\tsg_gen\nзамок\tза'мок\tm\tза'мка\nдом\tдом\tm\t-\n")
    (folder / "2.tsv").write_text("bare\taccented\tsg_gen\nзамок\tзамо'к\t\n")
    got = rows(files.read_stress(spark, [str(folder / "1.tsv"), str(folder / "2.tsv")]), "bare")
    assert {k: r.accented for k, r in got.items()} == {"замок": "за́мок", "замка": "за́мка"}


def test_sinks(spark):
    base = shared_dir(spark)
    calls = spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-02 10:00:00", 2.0)], "ts string, cost double").withColumn("ts", F.to_timestamp("ts"))
    files.append_ledger(calls, f"{base}/ledger")
    files.append_ledger(calls, f"{base}/ledger")
    assert spark.read.parquet(f"{base}/ledger").groupBy("date").count().filter("count = 2").count() == 2
    score = lambda m, v: spark.createDataFrame([(m, v)], "model string, score double")
    files.write_snapshot(score("a", 1.0).unionByName(score("b", 2.0)), f"{base}/snap")
    files.write_snapshot(score("b", 3.0), f"{base}/snap")
    assert {r.model: r.score for r in spark.read.parquet(f"{base}/snap").collect()} == {"a": 1.0, "b": 3.0}
    names = [c for c, _, _ in files.FEATURE_FORMATS]
    files.write_features(spark.createDataFrame([tuple(1.256 for _ in names)], ", ".join(f"{n} double" for n in names)), f"{base}/features")
    row = spark.read.option("header", True).csv(f"{base}/features").first()
    assert (row.exagg, row.rms) == ("1.26", "1.3")


def test_log_source(spark, folder):
    from voxframe.operators.text import parse_logs

    (folder / "run.log").write_text("step=5 loss=0.25\nx SyntaxWarning: y\n\nhello\nProcessed 20/126 files, 0.08 hours\n[train] DONE\n")
    got = parse_logs(files.read_log(spark, str(folder / "run.log")))
    assert got.count() == 4


def test_counters(spark):
    clips = spark.createDataFrame([("a", 30.0), ("b", 90.0), ("c", 60.0)], "clip string, duration_s double")
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "clip string, text string")
    row = files.dataset_counters(clips, texts, max_s=60.0).first()
    assert (row.files, row.matched, row.kept, row.minutes) == (3, 2, 1, 0.5)
