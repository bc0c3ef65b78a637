"""Settings of the detection operators, with two presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class ScoreConfig:
    reads: int = 3
    window_s: float = 3.0
    fine_margin_s: float = 2.0


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 16000
    window_ms: int = 200
    baseline_s: float = 10.0
    spike_db: float = 8.0
    cooldown_s: float = 1.5
    floor_db: float = -55.0
    normalize_pcm: bool = False

    @property
    def window_samples(self) -> int:
        return max(1, int(self.rate * self.window_ms / 1000 + 0.5))

    @property
    def baseline_windows(self) -> int:
        return max(1, int(self.baseline_s * 1000 / self.window_ms + 0.5))

    @property
    def cooldown_windows(self) -> int:
        return max(0, int(self.cooldown_s * 1000 / self.window_ms + 0.5))

    @property
    def least_history(self) -> int:
        return max(2, -(-self.baseline_windows // 5))


@dataclass(frozen=True)
class EventConfig:
    cluster_gap_s: float = 8.0
    lookback_s: float = 12.0
    fallback_offset_s: float = 4.0
    onset_db: float = 1.0
    dedup_s: float = 20.0
    weight_score_change: float = 0.7
    weight_audio_spike: float = 0.15
    weight_agreeing: float = 0.05
    weight_keyword: float = 0.1
    one_event_per_change: bool = False


@dataclass(frozen=True)
class ClipConfig:
    pre_s: float = 14.0
    post_s: float = 12.0
    max_s: float = 30.0
    for_unknown: bool = False


@dataclass(frozen=True)
class TrackConfig:
    fps: float = 3.0
    ball_trust: float = 0.05
    iou: float = 0.5
    top_k: int = 6
    padding_px: float = 60.0
    hold_s: float = 1.0
    recenter_s: float = 1.0
    smoothing_s: float = 0.6
    pan: float = 0.6
    lead: float = 0.5


@dataclass(frozen=True)
class Config:
    score: ScoreConfig = field(default_factory=ScoreConfig)
    audio: AudioConfig = field(default_factory=AudioConfig)
    events: EventConfig = field(default_factory=EventConfig)
    clips: ClipConfig = field(default_factory=ClipConfig)
    tracking: TrackConfig = field(default_factory=TrackConfig)


BUILTIN = Config()
#: Longer clips, a denser and faster track.
SHIPPED = replace(BUILTIN, clips=ClipConfig(25.0, 10.0, 35.0), tracking=replace(BUILTIN.tracking, fps=6.0, pan=1.0))


def merge(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """over wins leaf by leaf; lists and nulls replace. A null layer changes nothing."""
    if over is None:
        return base
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def configured(base: Config, layer: dict[str, Any] | None) -> Config:
    """base with a nested dict laid over it; unknown keys are ignored, wrong types refused."""

    def lay(current, values):
        known = {}
        for f in fields(current):
            if f.name not in values:
                continue
            old, new = getattr(current, f.name), values[f.name]
            if is_dataclass(old):
                if not isinstance(new, dict):
                    raise ValueError(f"{f.name}: a mapping is needed")
                known[f.name] = lay(old, new)
            elif isinstance(old, bool) != isinstance(new, bool) or not isinstance(new, (int, float, bool)) or new != new or abs(new) == float("inf"):
                raise ValueError(f"{f.name}: {new!r} is no finite {type(old).__name__}")
            else:
                known[f.name] = type(old)(new)
        return replace(current, **known)

    out = lay(base, layer or {})
    return validated(out)


def validated(c: Config) -> Config:
    positive = {
        "score.reads": c.score.reads, "score.window_s": c.score.window_s, "audio.rate": c.audio.rate, "audio.window_ms": c.audio.window_ms,
        "audio.baseline_s": c.audio.baseline_s, "events.cluster_gap_s": c.events.cluster_gap_s, "clips.max_s": c.clips.max_s, "tracking.fps": c.tracking.fps,
    }
    for name, value in positive.items():
        if not value > 0:
            raise ValueError(f"{name}: must be above 0")
    for name, value in {"clips.pre_s": c.clips.pre_s, "clips.post_s": c.clips.post_s, "events.dedup_s": c.events.dedup_s}.items():
        if value < 0:
            raise ValueError(f"{name}: must not be below 0")
    return c


def load(path: str | None, *layers: dict[str, Any] | None, base: Config = BUILTIN) -> Config:
    """A YAML file (a missing one is no layer), then other layers, over base."""
    import os

    merged: dict[str, Any] = {}
    if path and os.path.exists(path):
        import yaml

        with open(path) as f:
            merged = merge(merged, yaml.safe_load(f) or {})
    for layer in layers:
        merged = merge(merged, layer)
    return configured(base, merged)
