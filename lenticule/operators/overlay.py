"""Pictures for looking at results: boxes, lines and markers drawn on copies of images."""

from __future__ import annotations

import numpy as np


def draw_box(image: np.ndarray, x: int, y: int, width: int, height: int, colour: tuple[int, ...], thick: int = 2) -> None:
    h, w = image.shape[:2]
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + width, w), min(y + height, h)
    if x1 <= x0 or y1 <= y0:
        return
    t = min(thick, x1 - x0, y1 - y0)
    for rows, cols in ((slice(y0, y0 + t), slice(x0, x1)), (slice(y1 - t, y1), slice(x0, x1)), (slice(y0, y1), slice(x0, x0 + t)), (slice(y0, y1), slice(x1 - t, x1))):
        image[rows, cols, :3] = colour


def draw_line(image: np.ndarray, x0: float, y0: float, x1: float, y1: float, colour: tuple[int, ...], thick: int = 1) -> None:
    n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
    xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
    for dy in range(-(thick // 2), (thick + 1) // 2):
        for dx in range(-(thick // 2), (thick + 1) // 2):
            ok = (xs + dx >= 0) & (xs + dx < image.shape[1]) & (ys + dy >= 0) & (ys + dy < image.shape[0])
            image[ys[ok] + dy, xs[ok] + dx, :3] = colour


def draw_cross(image: np.ndarray, x: float, y: float, colour: tuple[int, ...], reach: int = 4) -> None:
    draw_line(image, x - reach, y, x + reach, y, colour)
    draw_line(image, x, y - reach, x, y + reach, colour)


def rois(image: np.ndarray, rects: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = image.copy()
    for i, r in enumerate(rects):
        draw_box(out, *r, ((255, 64, 64), (64, 255, 64), (64, 128, 255))[i % 3], 3)
    return out


def keypoints(image: np.ndarray, points: list[tuple[float, float]]) -> np.ndarray:
    out = image.copy()
    for x, y in points:
        draw_cross(out, x, y, (0, 255, 0))
    return out


def matches(left: np.ndarray, right: np.ndarray, pairs: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Both frames side by side, with a line for each match."""
    h = max(left.shape[0], right.shape[0])
    out = np.zeros((h, left.shape[1] + right.shape[1], 3), np.uint8)
    out[: left.shape[0], : left.shape[1]] = left[:, :, :3]
    out[: right.shape[0], left.shape[1] :] = right[:, :, :3]
    for x0, y0, x1, y1 in pairs:
        draw_line(out, x0, y0, x1 + left.shape[1], y1, (255, 200, 0))
    return out


def faces(image: np.ndarray, boxes: list[tuple[float, float, float, float]], best: int | None = None) -> np.ndarray:
    """Normalised boxes; the dominant one stands out."""
    out = image.copy()
    h, w = image.shape[:2]
    for i, (x, y, bw, bh) in enumerate(boxes):
        draw_box(out, round(x * w), round(y * h), round(bw * w), round(bh * h), (255, 215, 0) if i == best else (0, 200, 255), 3 if i == best else 2)
    return out
