"""Skeletons drawn pixel by pixel, to hold the plan in ``operators.skeleton`` against."""

import math

import numpy as np

from trailmark.operators.skeleton import FULL, TRUNK


def capsules(points: np.ndarray, sure: np.ndarray, shape: tuple[int, int], offset: tuple[float, float], bones=FULL, thickness: int = 7) -> np.ndarray:
    """A mask of ``shape`` (height, width) of all bones whose two joints are sure."""
    mask, reach = np.zeros(shape, dtype=bool), max(1, thickness) / 2
    for a, b in bones:
        if a >= len(points) or b >= len(points) or not (sure[a] and sure[b]):
            continue
        p, q = (np.array([round(float(points[k][c]) - float(offset[c])) for c in (0, 1)], dtype=float) for k in (a, b))
        lo, hi = np.floor(np.minimum(p, q) - reach).astype(int), np.ceil(np.maximum(p, q) + reach).astype(int) + 1
        x0, y0, x1, y1 = max(0, lo[0]), max(0, lo[1]), min(shape[1], hi[0]), min(shape[0], hi[1])
        if x1 <= x0 or y1 <= y0:
            continue
        x, y = np.arange(x0, x1, dtype=float)[None, :], np.arange(y0, y1, dtype=float)[:, None]
        v = q - p
        length = float(v @ v)
        t = np.clip(((x - p[0]) * v[0] + (y - p[1]) * v[1]) / length, 0, 1) if length else np.zeros((y1 - y0, x1 - x0))
        mask[y0:y1, x0:x1] |= (x - p[0] - t * v[0]) ** 2 + (y - p[1] - t * v[1]) ** 2 <= reach * reach
    return mask


def mask_iou(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """0 where a mask is missing, empty or of another shape."""
    if a is None or b is None or a.shape != b.shape or not a.size:
        return 0.0
    union = float((a | b).sum())
    return float((a & b).sum()) / union if union > 1e-9 else 0.0


def person(points, conf, box=None, least: float = 0.05) -> dict:
    """Points, which of them are sure, and the given box or that of the sure points (none without extent)."""
    xy = np.array([p[:2] for p in points] if points is not None else [], dtype=float).reshape(-1, 2)
    c = np.ones(len(xy)) if conf is None else np.zeros(len(xy))
    if conf is not None:
        some = np.array([np.nan if v is None else v for v in conf], dtype=float)[: len(xy)]
        c[: len(some)] = some
    sure = np.isfinite(xy).all(axis=1) & np.isfinite(c) & (c >= least)

    def sane(b):
        return b if b is not None and len(b) == 4 and all(v is not None and math.isfinite(v) for v in b) and b[2] > b[0] and b[3] > b[1] else None

    around = [*xy[sure].min(axis=0), *xy[sure].max(axis=0)] if sure.any() else None
    return {"points": xy, "sure": sure, "box": sane(box) or sane(around)}


def skeleton_overlap(a: dict, b: dict, full_weight: float = 0.35, trunk_weight: float = 0.65, thickness: int = 7) -> tuple[float, float, float]:
    """Score, overlap of the full skeletons and of the trunks, on a shared padded canvas."""
    boxes = [p["box"] for p in (a, b) if p["box"] is not None]
    if not boxes:
        return 0.0, 0.0, 0.0
    low, high, pad = np.min([x[:2] for x in boxes], axis=0), np.max([x[2:] for x in boxes], axis=0), max(1, 3 * max(1, thickness))
    shape = tuple(max(1, math.ceil(v)) for v in (high - low + 2 * pad)[::-1])
    offset = tuple(low - pad)
    full, trunk = (mask_iou(*(capsules(p["points"], p["sure"], shape, offset, bones, thickness) for p in (a, b))) for bones in (FULL, TRUNK))
    return full_weight * full + trunk_weight * trunk, full, trunk


def meets(a: dict, b: dict, axis: int, thickness: int) -> bool:
    if not a["sure"].any() or not b["sure"].any():
        return False
    x, y = a["points"][a["sure"], axis], b["points"][b["sure"], axis]
    return bool(x.min() - thickness <= y.max() + thickness and y.min() - thickness <= x.max() + thickness)
