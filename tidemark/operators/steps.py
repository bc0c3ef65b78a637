"""Steps of the folds that carry a state: the same for tables and for streams.

A step takes the state and what a row holds, and gives the next state and what comes of the row. States are plain tuples.
"""

from __future__ import annotations

from tidemark.config import ScoreConfig

Score = tuple[int, int]


def verdict(before: Score, after: Score) -> str:
    """Whether a match can go from one score to the other: by one goal, or by two or three of one side (suspicious)."""
    gained = after[0] - before[0], after[1] - before[1]
    if min(gained) < 0 or max(gained) == 0 or min(gained) > 0 or sum(gained) > 3:
        return "invalid"
    return "valid" if sum(gained) == 1 else "suspicious"


def score_step(cfg: ScoreConfig, current: Score | None, reads: list[tuple[float, Score]], t: float, now: Score) -> tuple[Score | None, list[tuple[float, Score]], tuple | None]:
    """The score that holds, the reads that may still confirm another, and what this one confirms: (kind, before, after, change_t, confirmed_t, validation).

    A score holds once cfg.reads reads of it lie within cfg.window_s. The first is the baseline; a later one is a change, or a rejection if no match could go
    that way, and then the old score stays.
    """
    if current == now:
        return current, [], None
    reads = [r for r in reads if t - r[0] <= cfg.window_s] + [(t, now)]
    alike = [r[0] for r in reads if r[1] == now]
    if len(alike) < cfg.reads:
        return current, reads, None
    if current is None:
        return now, [], ("baseline", None, now, alike[0], t, None)
    found = verdict(current, now)
    change = ("rejection" if found == "invalid" else "change", current, now, alike[0], t, found)
    return (current if found == "invalid" else now), [], change


def read_step(last: int | None, burst: int, frame: int, difference: float | None, threshold: float, refresh: int, reads: int) -> tuple[int | None, int, bool]:
    """The last frame read, the reads left of a burst, and whether this frame is read: the first, a changed one, one of the burst after a read, or one that is due.

    A read arms a burst of reads - 1 more, unless it is itself of a burst.
    """
    fresh = last is None or (difference is not None and difference >= threshold)
    in_burst = not fresh and burst > 0
    read = fresh or in_burst or frame - last >= refresh
    return (frame if read else last), (burst - 1 if in_burst else reads - 1 if read else burst), read


def _apart(a: dict, b: dict) -> float:
    return abs(a["x"] - b["x"]) + abs(a["y"] - b["y"])


def follow_step(state: tuple, balls: list[dict], cluster: dict | None, trust: float, most: float, confirm: int, resync: int) -> tuple[tuple, dict | None]:
    """What is followed in a frame, null if lost. balls: most confident first. State: the ball linked, for how many frames, what was followed last, frames lost since.

    The first trusted ball near the one linked before (any, without one) is linked, and followed once it is so in `confirm` frames running. Else the cluster is, if within
    twice `most` of what was followed last; after `resync` frames without a target any will do.
    """
    linked, streak, last, lost = state
    ball = next((b for b in balls if b["confidence"] >= trust and (linked is None or _apart(b, linked) <= most)), None)
    streak = streak + 1 if ball else 0
    anchor = None if lost >= resync else last
    if streak >= confirm:
        target = ball
    else:
        target = cluster if cluster and (anchor is None or _apart(cluster, anchor) <= 2 * most) else None
    return (ball, streak, target or anchor, 0 if target else lost + 1), target
