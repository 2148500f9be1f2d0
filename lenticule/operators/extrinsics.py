"""Camera offsets of an image from pair observations, by iteratively reweighted least squares over a tree of spans.

Observations are rows (image_id, frame_a, frame_b, base, cross, n), at most a few dozen for an image, so each image is one small
numpy problem in ``applyInPandas``: an incidence matrix of spans, weighted by matches and by Huber's rule, with camera 0 at the origin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CAMERAS = 32


@dataclass(frozen=True)
class ExtrinsicsConfig:
    huber_px: float = 2.0
    chord_weight: float = 1.0
    most_residual_px: float = 15.0
    most_rmse_px: float = 25.0
    monotonic: bool = True
    iterations: int = 10
    epsilon: float = 1e-4


def span_frame(n: int, seen: dict[tuple[int, int], tuple[float, float, int]]) -> pd.DataFrame:
    """Spans of length 1, 2, 4, ... by level, and the whole array if none of them is it; with what was observed and what the parts add up to.

    A part that is no span adds nothing, which happens below the whole array's own span only.
    """
    rows = []
    level = 0
    while (1 << level) < n:
        step = 1 << level
        rows += [(i, i + step, i + step // 2, level) for i in range(n - step)]
        level += 1
    if n > 2 and not any(r[0] == 0 and r[1] == n - 1 for r in rows):
        rows.append((0, n - 1, n // 2, level))
    known: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for start, end, mid, lvl in rows:
        x, y, count = seen.get((start, end), (0.0, 0.0, 0))
        observed = np.array([x, y])
        if lvl == 0:
            whole = observed
        else:
            whole = known.get((start, mid), np.zeros(2)) + known.get((mid, end), np.zeros(2))
            if not count:
                observed = whole
        known[start, end] = whole
        out.append((start, end, mid, lvl, *observed, *whole, float(np.hypot(*(observed - whole))), count))
    return pd.DataFrame(out, columns=["start_frame", "end_frame", "mid_frame", "level", "obs_x", "obs_y", "comp_x", "comp_y", "residual", "matches"])


def _rms(values: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(values)))) if len(values) else 0.0


def solve(n: int, seen: dict[tuple[int, int], tuple[float, float, int]], c: ExtrinsicsConfig = ExtrinsicsConfig()) -> dict:
    """Positions and report of one array of n cameras; ``seen`` maps (source, target) to offsets along and across, and matches."""
    spans = span_frame(n, seen)
    pruned = (spans["level"] > 0) & (spans["matches"] > 0) & (spans["residual"] > c.most_residual_px)
    spans["status"] = np.where(pruned, "Pruned", np.where(spans["matches"] > 0, "Active", "Synthesized"))
    measured = ((spans["matches"] > 0) & ~pruned).to_numpy()
    level = spans["level"].to_numpy()
    before = _rms(spans["residual"].to_numpy()[measured & (level > 0)])

    adjacent = spans[spans["level"] == 0].sort_values("start_frame")[["obs_x", "obs_y"]].to_numpy()
    nominal = np.concatenate([np.zeros((1, 2)), np.cumsum(adjacent, axis=0)])

    incidence = np.zeros((len(spans), n))
    incidence[np.arange(len(spans)), spans["end_frame"]] = 1
    incidence[np.arange(len(spans)), spans["start_frame"]] -= 1
    chord = ((level > 0) & ~pruned).to_numpy() & (c.chord_weight > 0)
    rows = np.concatenate([incidence[measured], incidence[chord]])
    targets = np.concatenate([spans[["obs_x", "obs_y"]].to_numpy()[measured], spans[["comp_x", "comp_y"]].to_numpy()[chord]])
    weight = np.concatenate([np.sqrt(spans["matches"].to_numpy(dtype=float)[measured]), np.full(int(chord.sum()), c.chord_weight)])

    position, reason = nominal.copy(), None
    delta = max(c.huber_px, 0.1)
    for _ in range(c.iterations if n <= MOST_CAMERAS else 0):
        old = position.copy()
        for axis in (0, 1):
            off = np.abs(rows @ position[:, axis] - targets[:, axis])
            w = weight * np.minimum(1.0, delta / np.maximum(off, 1e-12))
            a = rows[:, 1:]
            normal = a.T @ (w[:, None] * a) + 1e-6 * np.eye(n - 1)
            if abs(np.linalg.det(normal / np.abs(normal).max())) == 0.0:
                reason = "the system of equations is singular"
                break
            position[1:, axis] = np.linalg.solve(normal, a.T @ (w * targets[:, axis]))
        if reason or np.abs(position - old).max() < c.epsilon:
            break
    if n > MOST_CAMERAS:
        reason = f"more than {MOST_CAMERAS} cameras"

    def error(where: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.hypot(*(spans[["obs_x", "obs_y"]].to_numpy()[where] - incidence[where] @ at).T)

    if reason is None:
        total = nominal[-1, 0]
        steps = np.diff(position[:, 0]) * np.sign(total)
        after = _rms(error(measured, position))
        if not np.isfinite(position).all():
            reason = "a position is not finite"
        elif c.monotonic and abs(total) > 1.0 and (steps <= 0).any():
            reason = f"cameras {int(np.argmax(steps <= 0))} and {int(np.argmax(steps <= 0)) + 1} are out of order"
        elif after > c.most_rmse_px:
            reason = f"rmse of {after:.2f} px is over {c.most_rmse_px:.2f} px"
        elif before > 1.0 and after > 1.5 * before:
            reason = f"rmse grew from {before:.2f} to {after:.2f} px"
    if reason is not None:
        position = nominal
    share = np.arange(n) / max(n - 1, 1)
    sags = (position[:, 1] - (position[0, 1] + share * (position[-1, 1] - position[0, 1])))[1:-1]
    after = _rms(error(measured, position))
    return {
        "positions": position,
        "adjacent": np.diff(position, axis=0),
        "sags": sags,
        "rmse_before": before,
        "rmse_after": after,
        "improvement": (before - after) / before * 100 if before > 1e-4 else 0.0,
        "level_rmse": [_rms(error(measured & (level == k), position)) for k in range(int(level.max(initial=0)) + 1)],
        "pruned": int(pruned.sum()),
        "fallback": reason,
        "spans": spans,
    }


REPORT = "image_id string, cameras int, x array<double>, y array<double>, sags array<double>, rmse_before double, rmse_after double, improvement double, level_rmse array<double>, pruned int, fallback string"


def estimate(observations: DataFrame, config: ExtrinsicsConfig = ExtrinsicsConfig()) -> DataFrame:
    """One report for each image with at least three frames."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n = int(max(part["frame_a"].max(), part["frame_b"].max())) + 1
        if n < 3:
            return pd.DataFrame(columns=["image_id", "cameras", "x", "y", "sags", "rmse_before", "rmse_after", "improvement", "level_rmse", "pruned", "fallback"])
        r = solve(n, {(int(a), int(b)): (x, y, int(k)) for a, b, x, y, k in zip(part["frame_a"], part["frame_b"], part["base"], part["cross"], part["n"], strict=True)}, config)
        return pd.DataFrame([(part["image_id"].iloc[0], n, r["positions"][:, 0].tolist(), r["positions"][:, 1].tolist(), r["sags"].tolist(), r["rmse_before"], r["rmse_after"], r["improvement"], r["level_rmse"], r["pruned"], r["fallback"])], columns=[c.split()[0] for c in REPORT.split(", ")])

    return observations.select(F.col("image_id").cast("string").alias("image_id"), "frame_a", "frame_b", "base", "cross", "n").groupBy("image_id").applyInPandas(run, REPORT)
