"""Fixed values the results depend on, as plain tables."""

# Gap metrics with unit and full-scale difference.
METRIC_DEFS = [
    ("Loudness", "dBFS", 10.0),
    ("Dynamic range", "dB", 10.0),
    ("Brightness", "Hz", 1000.0),
    ("Tone purity", "", 0.5),
    ("Noise texture", "/s", 500.0),
    ("Duration", "s", 3.0),
    ("Speech rate", "f/s", 50.0),
    ("Voice presence", "", 0.5),
    ("Pitch variation", "Hz", 150.0),
    ("Bass balance", "dB", 15.0),
    ("Vocal darkness", "dB/oct", 8.0),
    ("Vocal weight", "Hz", 500.0),
    ("Breathiness", "dB", 10.0),
]

# Weights of the tuning objective and the score of a missing metric.
OBJECTIVE_WEIGHTS = [
    ("Brightness", 0.35),
    ("Loudness", 0.25),
    ("Voice presence", 0.15),
    ("Vocal darkness", 0.15),
    ("Bass balance", 0.10),
]
OBJECTIVE_MISSING = 50.0

# Metrics shown in sweep and variant reports.
REPORT_METRICS = ["Brightness", "Loudness", "Bass balance", "Vocal darkness", "Breathiness"]

# Correction controller defaults.
CONTROLLER = {
    "damping": 0.9,
    "targets": {
        "brightness_hz": 2288.0,
        "loudness_db": -13.5,
        "bass_balance_db": 2.8,
        "vocal_darkness_db_oct": -6.4,
    },
    "sensitivity": {
        "brightness_per_tilt_high": 92.0,
        "brightness_per_de_harsh": 0.16,
        "loudness_per_rms_lufs": 0.975,
        "bass_balance_per_tilt_low": 0.21,
        "bass_balance_per_presence": -0.36,
        "darkness_per_tilt_high": 0.073,
    },
    "ranges": {
        "tilt_low_db": (-4.0, 16.0),
        "tilt_high_db": (-24.0, 0.0),
        "rms_target_lufs": (-22.0, -4.0),
        "presence_db": (-6.0, 6.0),
        "de_harsh_db": (-12.0, 0.0),
    },
}

# Target offsets per emotion (metric, added amount).
EMOTION_OFFSETS = [
    ("angry", "brightness_hz", 100.0),
    ("angry", "loudness_db", 1.0),
    ("tired", "vocal_darkness_db_oct", -1.0),
    ("tired", "loudness_db", -1.0),
    ("excited", "brightness_hz", 50.0),
    ("excited", "loudness_db", 0.5),
    ("sarcastic", "brightness_hz", 80.0),
]

# Persona anchor and weight levels, and the two named personas.
REST = {"silent": 0.1, "low": 0.3, "mid": 0.5, "high": 0.7, "very_high": 0.9}
REACTS = {"inverts": -1.0, "counters": -0.5, "ignores": 0.0, "dampens": 0.3, "mirrors": 1.0, "amplifies": 1.5}
PERSONAS = {
    "diomedes": (("high", "amplifies"), ("very_high", "ignores"), ("low", "dampens")),
    "sidorovich": (("low", "dampens"), ("mid", "dampens"), ("low", "counters")),
}
PERSONA_DEFAULT = (("mid", "mirrors"), ("mid", "mirrors"), ("mid", "mirrors"))

# Arc phases as (upper share, name, arousal, dominance, valence) multipliers.
ARC_PHASES = [
    (0.2, "opening", 0.6, 0.8, 1.2),
    (0.6, "build", 0.9, 1.0, 1.0),
    (0.85, "climax", 1.3, 1.2, 0.7),
    (None, "resolution", 0.7, 0.9, 1.4),
]
# Fixed values: (phase, axis) pairs that are capped at 1 after the multiplier.
ARC_CAPPED = [("climax", "arousal"), ("climax", "dominance"), ("resolution", "valence")]
# Delimiter multipliers (arousal, dominance, valence) and capped axes.
DELIMITER_NUDGES = [
    ("exclamation", 1.3, 1.1, 1.0, ["arousal", "dominance"]),
    ("question", 0.9, 0.8, 1.2, ["valence"]),
    ("ellipsis", 0.6, 0.9, 1.0, []),
    ("dash", 1.1, 1.0, 0.9, ["arousal"]),
]

# Axis labels of the three-axis palette.
ENERGY = {"flat": 0.30, "calm": 0.50, "moderate": 0.70, "strong": 1.00, "intense": 1.20, "explosive": 1.50, "extreme": 1.70}
AUTHORITY = {"commanding": 0.10, "firm": 0.20, "confident": 0.30, "balanced": 0.40, "tentative": 0.50, "loose": 0.60}
TONE = {"frozen": 0.30, "cold": 0.50, "cool": 0.65, "neutral": 0.80, "warm": 1.00, "hot": 1.20}
# Named shades as (name, energy, authority, tone).
SHADES = [
    ("whisper", "flat", "loose", "cool"),
    ("deadpan", "flat", "loose", "cold"),
    ("pondering", "flat", "loose", "hot"),
    ("solemn", "flat", "confident", "cold"),
    ("reverent", "calm", "tentative", "warm"),
    ("measured", "calm", "balanced", "neutral"),
    ("riffing", "calm", "loose", "hot"),
    ("warm", "moderate", "balanced", "warm"),
    ("curious", "moderate", "tentative", "neutral"),
    ("awe", "moderate", "loose", "hot"),
    ("firm", "moderate", "firm", "cool"),
    ("sarcastic", "moderate", "confident", "cold"),
    ("conviction", "strong", "confident", "warm"),
    ("encouraging", "strong", "confident", "hot"),
    ("menacing", "strong", "commanding", "frozen"),
    ("commanding", "intense", "commanding", "cool"),
    ("rallying", "intense", "firm", "neutral"),
    ("triumphant", "intense", "commanding", "warm"),
    ("battle_cry", "explosive", "commanding", "frozen"),
    ("rage", "extreme", "commanding", "frozen"),
    ("revelation", "strong", "loose", "hot"),
    ("anthemic", "intense", "tentative", "warm"),
    ("transcendent", "intense", "loose", "hot"),
]
SHADE_DEFAULT = (0.5, 0.5, 0.8)

# Presets used when no preset file can be read.
DEFAULT_PRESETS = [
    ("baseline", {"rmsTargetLufs": -8.0, "compressionRatio": 4.0, "compressionMakeupDb": 5.0, "tiltLowDb": 10.0, "tiltHighDb": -8.0, "vibratoFreq": 6.0, "vibratoDepth": 0.003}),
    ("warm", {"rmsTargetLufs": -8.0, "compressionRatio": 3.0, "compressionMakeupDb": 4.0, "tiltLowDb": 14.0, "tiltHighDb": -10.0, "vibratoFreq": 6.0, "vibratoDepth": 0.003}),
    ("punchy", {"rmsTargetLufs": -6.0, "compressionRatio": 6.0, "compressionMakeupDb": 6.0, "tiltLowDb": 8.0, "tiltHighDb": -6.0, "vibratoFreq": 5.0, "vibratoDepth": 0.002}),
    ("bright", {"rmsTargetLufs": -9.0, "compressionRatio": 3.0, "compressionMakeupDb": 3.0, "tiltLowDb": 6.0, "tiltHighDb": -4.0, "presenceDb": 2.0, "deEssDb": 3.0, "vibratoFreq": 6.0, "vibratoDepth": 0.003}),
]

# Companion fields described through their primary field.
ABSORBED_FIELDS = [
    "saturationAmount",
    "saturationFreq",
    "reverbDecay",
    "reverbInputGain",
    "reverbOutputGain",
    "vibratoDepth",
    "deHarshFreq",
    "deHarshBandwidthOctaves",
    "deBoxFreq",
    "deBoxBandwidthOctaves",
    "warmthFreq",
    "airFreq",
    "compressionReleaseMs",
    "compressionThresholdDb",
]

# Spend model of one synthesis call.
GPU_BASE_S = 3.0
GPU_PER_AUDIO_S = 0.3
GPU_USD_PER_S = 0.000306

# Pause budget per delimiter, milliseconds.
BREAK_MS = {
    "comma": 150,
    "semicolon": 220,
    "colon": 180,
    "dash": 200,
    "ellipsis": 420,
    "period": 320,
    "exclamation": 300,
    "question": 350,
}
