"""Vector, box and score expressions, all built from column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """0 where lengths differ or a norm is below ``floor``."""
    n, m = norm(a), norm(b)
    return F.when((F.size(a) != F.size(b)) | (n < floor) | (m < floor), 0.0).otherwise(dot(a, b) / (n * m))


def masked_cosine(a: Column, b: Column, mask: Column) -> Column:
    """Over the places of ``mask``; a mask of another length, or all false, is ignored."""
    use = (F.size(mask) == F.size(a)) & F.exists(mask, lambda x: x)
    keep = lambda v: F.when(use, F.zip_with(v, mask, lambda x, k: F.when(k, x.cast("double")).otherwise(F.lit(0.0)))).otherwise(F.transform(v, lambda x: x.cast("double")))
    return cosine(keep(a), keep(b))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded as SQL engines do: what is scaled by a power of ten goes to the nearest
    whole number, halves away from 0, and a small negative value becomes -0.0."""
    near = F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed one time, also where ``use`` needs it
    inside a lambda (there Spark would compute an expression again for each element)."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column, floor: float = 1e-8) -> Column:
    """Scaled to length 1; null if empty, not finite or of a norm up to ``floor``."""

    def scaled(s: Column) -> Column:
        ok = (F.size(s["a"]) > 0) & ~F.isnan(s["n"]) & (s["n"] < float("inf")) & (s["n"] > floor)
        return F.when(ok, F.transform(s["a"], lambda x: x.cast("double") / s["n"]))

    return once(F.struct(a.alias("a"), norm(a).alias("n")), scaled)


def _times(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(w))


def fuse(parts: list[tuple[Column, float, int]]) -> tuple[Column, Column]:
    """Weighted unit parts, each (vector, weight, width), laid end to end and scaled
    to length 1, and the visible share of the weight. The first part is mandatory;
    an absent part or one of another width is zeros."""
    units = [F.when(F.size(v) == width, unit(v)) for v, _, width in parts]
    filled = [F.coalesce(u, F.array_repeat(F.lit(0.0), width)) for u, (_, _, width) in zip(units, parts, strict=True)]
    scaled = [_times(f, w) for f, (_, w, _) in zip(filled, parts, strict=True)]
    total = sum(w for _, w, _ in parts if w > 0)
    seen = sum((F.when(u.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for u, (_, w, _) in zip(units, parts, strict=True)), F.lit(0.0))
    whole = once(F.when(units[0].isNotNull(), F.concat(*scaled)), unit)
    return whole, F.when(units[0].isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), seen / F.lit(total)))).otherwise(F.lit(0.0))


def fuse_mask(parts: list[tuple[Column, float, int]]) -> Column:
    """Which places of the vector of ``fuse`` come from a part that is there; null
    where there is no vector."""
    there = [F.when(F.size(v) == width, unit(v)).isNotNull() for v, _, width in parts]
    places = F.concat(*(F.array_repeat(t, width) for t, (_, _, width) in zip(there, parts, strict=True)))
    return F.when(fuse(parts)[0].isNotNull(), places)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Of boxes x1, y1, x2, y2; 0 where the union is no more than 1e-9."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda q: F.greatest(F.lit(0.0), q[2] - q[0]) * F.greatest(F.lit(0.0), q[3] - q[1])
    union = area(a) + area(b) - w * h
    return F.when(union <= 1e-9, 0.0).otherwise(w * h / union)


def log_ratio_penalty(value: Column, best: Column, k: float, eps: float = 1e-6) -> Column:
    """ln of the ratio to the best, on the scale of ln k, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log((value + eps) / (best + eps)) / F.log(F.lit(max(k, 1.000001)))))


def closeness(distance: Column, close: float = 0.04, near: float = 0.15) -> Column:
    return F.when(distance <= close, "very_close").when(distance <= near, "near").otherwise("far")


def miss_relaxation(confirmed: Column, misses: Column, full: float = 20.0) -> Column:
    return F.when(confirmed, F.greatest(F.lit(0.0), F.least(F.lit(1.0), misses / F.lit(full)))).otherwise(0.0)


def contrastive(label: Column, distance: Column, margin: float) -> Column:
    gap = F.greatest(F.lit(margin) - distance, F.lit(0.0))
    return label * distance * distance + (F.lit(1.0) - label) * gap * gap


def visible_points(kp_conf: Column) -> Column:
    return F.size(F.filter(kp_conf, lambda c: c > 0))


def ema(values: Column, alpha: float, start: float = 1.0) -> Column:
    """The last state of g <- (1 - alpha) g + alpha clip(v, 0, 1), from ``start``."""
    return F.aggregate(values, F.lit(start), lambda g, v: g * (1 - alpha) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * alpha)


def kalman_axis(values: Column, dt: float = 1 / 30, process: float = 1e7, measure: float = 5000.0, p0: float = 1000.0) -> Column:
    """A constant-velocity filter along one axis: struct x, v, a, b, c after all values.

    The covariance is three numbers; position and velocity of an axis do not
    depend on the other axis, so a fold over sorted values is the whole filter.
    """
    q11, q12, q22 = process * dt**4 / 4, process * dt**3 / 2, process * dt**2

    def step(s, z):
        x, a, b, c = s["x"] + s["v"] * dt, s["a"] + s["b"] * (2 * dt) + s["c"] * dt**2 + q11, s["b"] + s["c"] * dt + q12, s["c"] + q22
        gain = a + measure
        return F.struct((x + a / gain * (z - x)).alias("x"), (s["v"] + b / gain * (z - x)).alias("v"), (a * measure / gain).alias("a"), (b * measure / gain).alias("b"), (c - b * b / gain).alias("c"))

    first = F.struct(values[0].alias("x"), F.lit(0.0).alias("v"), F.lit(p0).alias("a"), F.lit(0.0).alias("b"), F.lit(p0).alias("c"))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), first, step)


def overlap_zone(distance: Column, stable: Column, zones: tuple[tuple[str, float, float], ...] = (("near", 0.55, 0.003), ("mid", 0.85, 0.005), ("far", 1.20, 0.007)), default: float = 0.008) -> tuple[Column, Column]:
    """The overlap threshold of a pair by its scaled distance, and why; only stable pairs are graded."""
    value, reason = F.lit(default), F.lit("default")
    for name, limit, threshold in reversed(zones):
        hit = stable & (distance <= limit)
        value, reason = F.when(hit, F.lit(threshold)).otherwise(value), F.when(hit, F.lit(name)).otherwise(reason)
    return value, reason


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """A box inside an image, truncated to whole pixels; null where nothing is left."""
    inside = [F.greatest(F.lit(0.0), F.least(F.lit(float(m)), v)).cast("int") for v, m in ((x1, width - 1), (y1, height - 1), (x2, width - 1), (y2, height - 1))]
    return F.when((inside[2] > inside[0]) & (inside[3] > inside[1]), F.array(*inside))


def node_name(epoch: Column, local: Column) -> Column:
    return F.format_string("E%d:T%d", epoch, local)


def centred(points: Column, root: int) -> Column:
    """Points minus the root point, unless that is not finite or next to the origin."""
    r = points[root]
    usable = ~F.isnan(r[0]) & ~F.isnan(r[1]) & (F.abs(r[0]) + F.abs(r[1]) >= 1e-6)
    return F.when(usable, F.transform(points, lambda p: F.array(p[0] - r[0], p[1] - r[1]))).otherwise(points)


def global_ssim(a: Column, b: Column, c1: float = 1e-4, c2: float = 9e-4) -> Column:
    """Structural similarity of two equally long number arrays as one block."""

    n = F.nullif(F.size(a), F.lit(0))

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / n

    def value(s: Column) -> Column:
        va, vb, cov = s["aa"] - s["ma"] * s["ma"], s["bb"] - s["mb"] * s["mb"], s["ab"] - s["ma"] * s["mb"]
        den = (s["ma"] * s["ma"] + s["mb"] * s["mb"] + c1) * (va + vb + c2)
        return F.when(den <= 1e-12, 1.0).otherwise((s["ma"] * s["mb"] * 2 + c1) * (cov * 2 + c2) / den)

    return once(F.struct(mean(a).alias("ma"), mean(b).alias("mb"), (dot(a, a) / n).alias("aa"), (dot(b, b) / n).alias("bb"), (dot(a, b) / n).alias("ab")), value)
