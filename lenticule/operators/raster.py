"""Dense work on one image at a time, in numpy: luma rasters, filters, corners, crops, palettes."""

from __future__ import annotations

import numpy as np

from ..functions.color import BT709

MINOR_CAP = 1080


def half_up(x: np.ndarray | float) -> np.ndarray | float:
    """Rounded half away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def luma(rgb: np.ndarray, weights: tuple[float, float, float] = BT709) -> np.ndarray:
    if rgb.ndim == 2 or rgb.shape[2] < 3:
        return rgb.reshape(rgb.shape[:2] + (-1,))[:, :, 0]
    return np.clip(half_up(rgb[:, :, :3].astype(np.float64) @ np.array(weights)), 0, 255).astype(np.uint8)


def scaled_luma(rgb: np.ndarray, cap: int = MINOR_CAP) -> tuple[np.ndarray, float]:
    """Luma by nearest neighbour with its shorter side at most ``cap``, and the scale."""
    h, w = rgb.shape[:2]
    scale = min(1.0, cap / min(h, w))
    pick = lambda n: np.minimum(half_up(np.arange(max(1, int(half_up(n * scale)))) / scale), n - 1).astype(int)
    return luma(rgb[pick(h)][:, pick(w)]), scale


def median_3x3(raster: np.ndarray) -> np.ndarray:
    out = raster.copy()
    if min(raster.shape) >= 3:
        out[1:-1, 1:-1] = np.median(np.lib.stride_tricks.sliding_window_view(raster, (3, 3)), axis=(2, 3)).astype(raster.dtype)
    return out


def percentile(counts: np.ndarray, p: float) -> int:
    """First value whose running count reaches min(round(n p), n - 1)."""
    n = int(counts.sum())
    return int(np.argmax(np.cumsum(counts) >= min(half_up(n * min(max(p, 0.0), 1.0)), n - 1))) if n else 0


def gamma_stretch(raster: np.ndarray, gamma: float = 1.12, axis: int = 1) -> np.ndarray:
    """Values up to the baseline go to 0, the rest is stretched. The baseline is the 1 % percentile of the slices' 5 % percentiles."""
    slices = np.moveaxis(raster, axis, 0).reshape(raster.shape[axis], -1)
    lows = [percentile(np.bincount(s, minlength=256), 0.05) for s in slices]
    base = percentile(np.bincount(lows, minlength=256), 0.01)
    power = gamma if gamma > 0.1 else 1.0
    v = np.arange(256)
    table = np.where(v <= base, 0, half_up(255.0 * (np.maximum(v - base, 0) / max(255 - base, 1)) ** power))
    return np.clip(table, 0, 255).astype(np.uint8)[raster]


def profile(raster: np.ndarray, axis: int = 1) -> np.ndarray:
    """Rows (min, max, avg, std, p5, p98) of the slices along ``axis`` (1: columns of a horizontal strip)."""
    slices = np.moveaxis(raster, axis, 0).reshape(raster.shape[axis], -1)
    rows = []
    for s in slices:
        counts, x = np.bincount(s, minlength=256), s.astype(np.float64)
        rows.append((x.min(), x.max(), x.mean(), np.sqrt(max((x * x).mean() - x.mean() ** 2, 0.0)), percentile(counts, 0.05), percentile(counts, 0.98)))
    return np.array(rows)


def harris(raster: np.ndarray, k: float = 0.04) -> np.ndarray:
    """Corner response from central differences and sums of three by three; 0 at the border of two and below 0, at most 1."""
    f = raster.astype(np.float64) / 255.0
    out = np.zeros(f.shape)
    if min(f.shape) < 5:
        return out
    gx, gy = np.zeros(f.shape), np.zeros(f.shape)
    gx[:, 1:-1], gy[1:-1] = (f[:, 2:] - f[:, :-2]) / 2, (f[2:] - f[:-2]) / 2
    box = lambda a: np.lib.stride_tricks.sliding_window_view(a, (3, 3)).sum(axis=(2, 3))[1:-1, 1:-1]
    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    out[2:-2, 2:-2] = np.clip(xx * yy - xy * xy - k * (xx + yy) ** 2, 0.0, 1.0)
    return out


def peaks(score: np.ndarray, radius: int = 4, least: float = 0.005, border: int = 4, most: int = 4096) -> list[tuple[int, int, float]]:
    """(x, y, score) of pixels over which no other within the radius stands as high, strongest first; equal neighbours rule each other out."""
    h, w = score.shape
    padded = np.pad(score, radius, constant_values=-np.inf)
    around = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1)).reshape(h, w, -1)
    middle = around.shape[2] // 2
    rest = np.maximum(around[:, :, :middle].max(axis=2), around[:, :, middle + 1 :].max(axis=2)) if radius else np.full(score.shape, -np.inf)
    good = (score >= least) & (rest < score)
    inside = np.zeros(score.shape, dtype=bool)
    inside[border : h - border or None, border : w - border or None] = h > 2 * border and w > 2 * border
    y, x = np.nonzero(good & inside)
    order = np.lexsort((x, y, -score[y, x]))[:most]
    return [(int(x[i]), int(y[i]), float(score[y[i], x[i]])) for i in order]


def refine(raster: np.ndarray, x: float, y: float, radius: int = 7, iterations: int = 5, epsilon: float = 0.01, most_step: float = 1.5, most_drift: float = 2.5) -> tuple[float, float, str]:
    """Sub-pixel corner: where the gradients around it, weighted by a Gaussian, all point across the line to it."""
    h, w = raster.shape
    image = raster.astype(np.float64) / 255.0
    span = np.arange(-radius, radius + 1)
    dx, dy = np.meshgrid(span, span)
    weight = np.exp(-(dx**2 + dy**2) / (2.0 * max(radius / 2, 1.0) ** 2))
    cx, cy = x, y
    for _ in range(iterations):
        if cx - radius - 2 < 0 or cy - radius - 2 < 0 or cx + radius + 2 > w - 1 or cy + radius + 2 > h - 1:
            return x, y, "BoundarySkipped"
        px, py = cx + dx, cy + dy

        def at(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            iu, iv = np.floor(u).astype(int), np.floor(v).astype(int)
            fu, fv = u - iu, v - iv
            return image[iv, iu] * (1 - fu) * (1 - fv) + image[iv, iu + 1] * fu * (1 - fv) + image[iv + 1, iu] * (1 - fu) * fv + image[iv + 1, iu + 1] * fu * fv

        gx, gy = (at(px + 1, py) - at(px - 1, py)) / 2, (at(px, py + 1) - at(px, py - 1)) / 2
        xx, yy, xy = (weight * gx * gx).sum(), (weight * gy * gy).sum(), (weight * gx * gy).sum()
        bx, by = (weight * (gx * gx * dx + gx * gy * dy)).sum(), (weight * (gx * gy * dx + gy * gy * dy)).sum()
        det, trace = xx * yy - xy * xy, xx + yy
        if det < 1e-7 or trace < 1e-5 or trace / 2 - np.sqrt(max(trace * trace / 4 - det, 0.0)) < 1e-5:
            return x, y, "PoorConditioning"
        sx, sy = (yy * bx - xy * by) / det, (xx * by - xy * bx) / det
        if np.hypot(sx, sy) > most_step:
            return x, y, "StepRejected"
        cx, cy = cx + sx, cy + sy
        if np.hypot(cx - x, cy - y) > most_drift:
            return x, y, "DriftRejected"
        if np.hypot(sx, sy) < epsilon:
            break
    return float(cx), float(cy), "Refined"


def align_and_crop(frames: list[np.ndarray], shifts: list[tuple[float, float]]) -> list[np.ndarray]:
    """Each frame's part of what all shifted frames share."""
    d = [(int(half_up(x)), int(half_up(y))) for x, y in shifts]
    x0, y0 = max(0, *(x for x, _ in d)), max(0, *(y for _, y in d))
    x1, y1 = min(x + f.shape[1] for f, (x, _) in zip(frames, d, strict=True)), min(y + f.shape[0] for f, (_, y) in zip(frames, d, strict=True))
    if x1 <= x0 or y1 <= y0:
        raise ValueError("the shifted frames share no area")
    return [f[y0 - y : y1 - y, x0 - x : x1 - x] for f, (x, y) in zip(frames, d, strict=True)]


def palette(frames: list[np.ndarray], colours: int = 256, every: int = 10) -> np.ndarray:
    """Colours shared by all frames, by median cut over every ``every``-th pixel."""
    px = np.concatenate([f.reshape(-1, f.shape[-1])[:, :3] for f in frames])[:: max(every, 1)].astype(np.int32)
    boxes = [px]
    while len(boxes) < colours:
        spread = [np.ptp(b, axis=0).max() if len(b) > 1 else 0 for b in boxes]
        i = int(np.argmax(spread))
        if spread[i] == 0:
            break
        box = boxes.pop(i)
        box = box[np.argsort(box[:, int(np.argmax(np.ptp(box, axis=0)))], kind="stable")]
        boxes += [box[: len(box) // 2], box[len(box) // 2 :]]
    return np.array([half_up(b.mean(axis=0)) for b in boxes]).astype(np.uint8)


def to_indices(frame: np.ndarray, colours: np.ndarray, dither: bool = False) -> np.ndarray:
    """Index of the nearest colour for each pixel; with error diffusion to the right and below if asked."""
    rgb, table = frame[:, :, :3].astype(np.float64), colours.astype(np.float64)

    def nearest(px: np.ndarray) -> np.ndarray:
        return ((px * px).sum(axis=1)[:, None] - 2 * px @ table.T + (table * table).sum(axis=1)[None]).argmin(axis=1)

    if not dither:
        h, w = rgb.shape[:2]
        flat = rgb.reshape(-1, 3)
        distinct, where = np.unique(flat, axis=0, return_inverse=True)
        codes = np.concatenate([nearest(distinct[i : i + 65536]) for i in range(0, len(distinct), 65536)])
        return codes[where.ravel()].reshape(h, w).astype(np.uint8)
    h, w = rgb.shape[:2]
    work, out = np.pad(rgb, ((0, 1), (1, 1), (0, 0))), np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            value = np.clip(work[y, x + 1], 0, 255)
            i = int(((table - value) ** 2).sum(axis=1).argmin())
            out[y, x] = i
            left = value - table[i]
            work[y, x + 2] += left * 7 / 16
            work[y + 1, x : x + 3] += left * np.array([[3 / 16], [5 / 16], [1 / 16]])
    return out
