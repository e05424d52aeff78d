"""Order-dependent session rules, one small step function each.

A step takes the state before (JSON, ``None`` at the start of a key) and the
ordered rows of one block or micro-batch, and returns output rows and the state
after.  ``streaming.stateful`` drives them; ``operators.recursions`` has the same rules for
batches, and the tests hold one against the other.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd

from voxframe.functions import textrules as tr

_CUT = re.compile(r"\n\n+|(?<=[.!?])\s+")


def _load(state: str | None, fresh: dict) -> dict:
    return json.loads(state) if state else dict(fresh)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


class _Step:
    """A step made of ``fold``, which takes the state as a dict and rows as dicts and gives lists of ``columns``."""

    def __init__(self, columns: list[str], fold):
        self.columns, self.fold = columns, fold

    def __call__(self, state: str | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        out, after = self.fold(json.loads(state) if state else None, rows.to_dict("records"))
        return _frame(out, self.columns), json.dumps(after, sort_keys=True)


def decayed(intensity: float, since_ms: float, half_life_ms: float) -> float:
    now = intensity * 2.0 ** (-since_ms / half_life_ms)
    return now if now >= tr.INTENSITY_FLOOR else 0.0


def emotion_state(keys: list[str], row_id: str):
    """Decaying emotion per session; rows carry ``ts_ms, emotion, confidence``."""
    columns = [*keys, row_id, "state_emotion", "state_intensity", "half_life_ms", "current_intensity"]
    fresh = {"emotion": "neutral", "intensity": 0.0, "at": 0.0, "half": tr.HALF_LIFE_MS}

    def fold(state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        s, out = dict(state or fresh), []
        for row in rows:
            now, mood, sure = float(row["ts_ms"]), row["emotion"], float(row["confidence"])
            level = 0.0 if s["emotion"] == "neutral" else decayed(s["intensity"], now - s["at"], s["half"])
            if mood == "neutral" or sure == 0.0:
                s["half"] = min(s["half"], tr.FAST_HALF_LIFE_MS)
            elif mood == s["emotion"] or sure >= level:
                joined = min(1.0, level + sure * tr.SAME_EMOTION_GAIN) if mood == s["emotion"] else sure
                s = {"emotion": mood, "intensity": joined, "at": now, "half": tr.HALF_LIFE_MS}
            else:
                s["intensity"], s["half"] = level * tr.OVERRULED_FACTOR, tr.FAST_HALF_LIFE_MS
            current = 0.0 if s["emotion"] == "neutral" else decayed(s["intensity"], now - s["at"], s["half"])
            out.append([*(row[k] for k in keys), row[row_id], s["emotion"], s["intensity"], s["half"], current])
        return out, s

    return _Step(columns, fold)


def cool_down(keys: list[str], row_id: str, cooldown_ms: float):
    """Keep a row only if the last kept one is at least ``cooldown_ms`` back."""
    columns = [*keys, row_id, "ts_ms"]

    def step(state: str | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        last = _load(state, {"last": None})["last"]
        times, keep = rows["ts_ms"].to_numpy(), []
        at = 0
        while at < len(times):
            if last is not None:
                at = max(at, int(np.searchsorted(times, last + cooldown_ms, side="left")))
                if at >= len(times):
                    break
            keep.append(at)
            last = float(times[at])
            at += 1
        return rows.iloc[keep][columns], json.dumps({"last": last})

    return step


def sentence_chunker(keys: list[str], row_id: str):
    """Deltas to sentence chunks, with code removal and an on/off gate.

    Rows carry ``type`` (delta, message_end, set_config, reset), ``text`` and
    ``enabled``.  Text is buffered while off; switching off clears, switching on
    cuts what has gathered; a message end flushes (on) or discards (off).
    """
    columns = [*keys, row_id, "chunk_idx", "chunk"]
    fresh = {"buffer": "", "ticks": 0, "block": False, "inline": False, "n": 0, "on": True}

    def clear(s: dict) -> dict:
        return {**fresh, "on": s["on"]}

    def feed(s: dict, text: str) -> None:
        for part in re.findall(r"`+|[^`]+", text):
            if part[0] == "`":
                s["ticks"] += len(part)
                continue
            if s["ticks"] >= 3:
                s["block"] = not s["block"]
            elif s["ticks"] and not s["block"]:
                s["inline"] = not s["inline"]
            s["ticks"] = 0
            if not s["block"] and not s["inline"]:
                s["buffer"] += part

    def drain(s: dict) -> list[str]:
        *done, s["buffer"] = _CUT.split(s["buffer"])
        return [c for c in (d.strip() for d in done) if len(c.encode()) > 2]

    def fold(state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        s, out = dict(state or fresh), []
        for row in rows:
            ready, kind = [], row["type"]
            if kind == "delta":
                feed(s, row["text"] or "")
                ready = drain(s) if s["on"] else []
            elif kind == "set_config":
                was, s["on"] = s["on"], bool(row["enabled"])
                if s["on"] and not was:
                    ready = drain(s)
                elif was and not s["on"]:
                    s = clear(s)
            elif kind == "message_end":
                left = s["buffer"].strip()
                ready = [left] if s["on"] and len(left.encode()) > 2 else []
            elif kind == "reset":
                s = clear(s)
            for chunk in ready:
                out.append([*(row[k] for k in keys), row[row_id], s["n"], chunk])
                s["n"] += 1
            if kind == "message_end":
                s = clear(s)
        return out, s

    return _Step(columns, fold)


def utterances(
    keys: list[str], threshold: float = 0.03, min_silence: int = 13, min_speech: int = 16, max_speech: int = 500
):
    """Frames to utterances; rows carry ``frame_idx, value, flush``.

    An utterance closes after ``min_silence`` silent frames (then trimmed), or is
    cut at ``max_speech`` speech frames; shorter ones are dropped.  ``flush`` marks
    the end of the stream, which keeps trailing silence.
    """
    columns = [*keys, "start_idx", "n_frames", "speech_frames"]
    idle = {"start": None, "length": 0, "speech": 0, "silence": 0}

    def fold(state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        s, out = dict(state or idle), []

        def close(row: dict, length: int) -> dict:
            out.append([*(row[k] for k in keys), s["start"], length, s["speech"]])
            return dict(idle)

        for row in rows:
            loud = row["value"] > threshold
            if loud or s["start"] is not None:
                if s["start"] is None:
                    s = {**idle, "start": int(row["frame_idx"])}
                s["length"] += 1
                s["speech"] += int(loud)
                s["silence"] = 0 if loud else s["silence"] + 1
                if s["silence"] >= min_silence:
                    s = close(row, s["length"] - s["silence"]) if s["speech"] >= min_speech else dict(idle)
                elif s["speech"] >= max_speech:
                    s = close(row, s["length"])
            if row["flush"] and s["start"] is not None:
                s = close(row, s["length"]) if s["speech"] >= min_speech else dict(idle)
        return out, s

    return _Step(columns, fold)


def filler(keys: list[str], row_id: str, alpha: float = 0.3):
    """Predicted round trip and filler per trip; rows carry ``rtt_ms, audio_bytes``."""
    columns = [*keys, row_id, "ema", "gap_ms", "total_filler_ms"]
    fresh = {"ema": None, "n": 0, "budget": None, "total": 0.0}

    def fold(state: dict | None, rows: list[dict]) -> tuple[list[list], dict]:
        s, out = dict(state or fresh), []
        for row in rows:
            rtt = float(row["rtt_ms"])
            s["ema"] = rtt if s["ema"] is None else alpha * rtt + (1.0 - alpha) * s["ema"]
            s["n"] += 1
            gap = max(0.0, s["ema"] - s["budget"]) if s["n"] >= 2 else 0.0
            s["total"] += gap
            s["budget"] = (row["audio_bytes"] - 44) / 2 / 24000 * 1000.0
            out.append([*(row[k] for k in keys), row[row_id], s["ema"], gap, s["total"]])
        return out, s

    return _Step(columns, fold)


def reassemble(keys: list[str]):
    """Emit index k only after 0..k-1; rows carry ``idx, payload, arrived``."""
    columns = [*keys, "idx", "payload", "released_by"]

    def step(state: str | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        s, out = _load(state, {"next": 0, "held": {}}), []
        for row in rows.to_dict("records"):
            s["held"][str(int(row["idx"]))] = row["payload"]
            while str(s["next"]) in s["held"]:
                payload = s["held"].pop(str(s["next"]))
                out.append([*(row[k] for k in keys), s["next"], payload, row["arrived"]])
                s["next"] += 1
        return _frame(out, columns), json.dumps(s, sort_keys=True)

    return step


def generation_fence(keys: list[str], row_id: str):
    """Drop results requested under an older generation.

    Rows carry ``type`` (reset, request, result) and ``request_id``.
    """
    columns = [*keys, row_id, "generation"]

    def step(state: str | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        s, out = _load(state, {"gen": 0, "open": []}), []
        for row in rows.to_dict("records"):
            if row["type"] == "reset":
                # everything still open is of an older generation from here on
                s = {"gen": s["gen"] + 1, "open": []}
            elif row["type"] == "request":
                s["open"].append(int(row[row_id]))
            elif int(row[row_id]) in s["open"]:
                s["open"].remove(int(row[row_id]))
                out.append([*(row[k] for k in keys), row[row_id], s["gen"]])
        return _frame(out, columns), json.dumps(s)

    return step


def recent_log(keys: list[str], capacity: int = 20):
    """Answer a resume with the logged chunks strictly after the last seen one.

    Rows carry ``type`` (chunk, resume), ``idx`` (chunk id or last seen), ``text``.
    """
    columns = [*keys, "resume_at", "idx", "text"]

    def step(state: str | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        log, out = _load(state, {"log": []})["log"], []
        for row in rows.to_dict("records"):
            if row["type"] == "chunk":
                log = [*log, [int(row["idx"]), row["text"]]][-capacity:]
            else:
                out += [[*(row[k] for k in keys), row["at"], i, t] for i, t in log if i > int(row["idx"])]
        return _frame(out, columns), json.dumps({"log": log})

    return step


def distinct_regions(keys: list[str], row_id: str, features: list[str], apart: float = 0.25):
    """First row is a centre; a later row is one if it is far from all before it."""
    columns = [*keys, row_id]

    def step(state: str | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, str]:
        centres = _load(state, {"centres": []})["centres"]
        keep = []
        for i, point in enumerate(rows[features].to_numpy(dtype=float)):
            known = np.array(centres)
            if not len(known) or np.sqrt(((known - point) ** 2).sum(axis=1)).min() > apart:
                centres.append([float(x) for x in point])
                keep.append(i)
        return rows.iloc[keep][columns], json.dumps({"centres": centres})

    return step
