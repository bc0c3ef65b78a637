"""Row schemas. Times are seconds from the start of a recording."""

from __future__ import annotations

SCORE = "struct<home: int, away: int>"

TABLES: dict[str, str] = {
    "media": "media_id string, path string, container string, duration_s double, width int, height int, fps double, video_codec string, audio_codec string, has_video boolean, has_audio boolean",
    "ocr_samples": f"media_id string, t double, ok boolean, score {SCORE}, confidence double, raw string, engine string, provider string, inference_s double, reused boolean, change_difference double",
    "pcm_chunks": "media_id string, chunk_idx bigint, sample_offset bigint, samples array<smallint>",
    "audio_windows": "media_id string, w bigint, t double, rms double, rms_db double, baseline_db double, delta_db double",
    "audio_spikes": "media_id string, t double, delta_db double, rms_db double",
    "score_changes": f"media_id string, seq int, `from` {SCORE}, `to` {SCORE}, change_t double, confirmed_t double, validation string, refined boolean",
    "signals": "media_id string, type string, t double, score_before string, score_after string, validation string, delta_db double, text string",
    "detections": "media_id string, frame bigint, t double, cls string, x double, y double, width double, height double, confidence double",
    "track_samples": "media_id string, clip_id string, t double, x double, y double, width double, height double, confidence double, kind string, lost boolean",
    "trajectory": "media_id string, clip_id string, frame int, x int",
    "truth": "media_id string, idx int, type string, t double, scoreboard_update double, score_after string",
}
