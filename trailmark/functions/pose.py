"""Likeness of poses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.geometry import JOINTS, SWAPS, finite
from trailmark.functions.vectors import once

#: Fixed values of the 25-point body layout: joints that count, bones between
#: them, roots of which one must be seen.
CORE = (1, 2, 3, 5, 6, 8, 9, 10, 12, 13)
BONES = ((1, 2), (2, 3), (1, 5), (5, 6), (1, 8), (8, 9), (9, 10), (8, 12), (12, 13))
ROOTS = (8, 1, 9, 12, 2, 5)


def _sure(points: Column, conf: Column, least: float) -> Column:
    """For each joint whether it counts, is finite and sure; all are sure without confidences."""

    def one(i: Column) -> Column:
        p = F.get(points, i)
        known = conf.isNull() | F.coalesce(F.get(conf, i) >= least, F.lit(False))
        return F.array_contains(F.array(*map(F.lit, CORE)), i) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))) & known

    return F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), one)


def _cosine(s: Column, swapped: bool) -> Column:
    """Of the bones whose four joints are sure in both poses, each of length 1."""
    places = list(range(JOINTS))
    if swapped:
        for a, b in SWAPS:
            places[a], places[b] = b, a
    shared = lambda i: s["ga"][i] & s["gb"][places[i]]

    def bone(i: int, j: int) -> Column:
        ax, ay = (s["a"][j][c] - s["a"][i][c] for c in (0, 1))
        bx, by = (s["b"][places[j]][c] - s["b"][places[i]][c] for c in (0, 1))
        na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
        ua, ub = na / (na + 1e-9), nb / (nb + 1e-9)
        dot = (ax * bx + ay * by) / ((na + 1e-9) * (nb + 1e-9))
        both = shared(i) & shared(j)
        return F.struct(*(F.when(both, v).otherwise(F.lit(0.0)).alias(n) for n, v in (("d", dot), ("a", ua * ua), ("b", ub * ub))))

    nothing = F.struct(*(F.lit(0.0).alias(n) for n in "dab"))
    total = F.aggregate(F.array(*(bone(i, j) for i, j in BONES)), nothing, lambda x, y: F.struct(*((x[n] + y[n]).alias(n) for n in "dab")))
    rooted = shared(ROOTS[0])
    for r in ROOTS[1:]:
        rooted = rooted | shared(r)
    size = lambda t: F.sqrt(t["a"]) * F.sqrt(t["b"])
    return F.when(rooted, once(total, lambda t: F.when(size(t) > 1e-8, t["d"] / size(t)).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def pose_similarity(a: Column, conf_a: Column, b: Column, conf_b: Column, least: float = 0.05) -> Column:
    """The larger cosine of two poses' bone directions, as given and with the sides
    of ``b`` swapped; never under 0, and 0 without shared joints, for poses of
    fewer than 25 points and for missing ones. Confidences may be null."""
    points = [F.transform(p, lambda q: F.transform(q, lambda v: v.cast("double"))) for p in (a, b)]
    confs = [c.cast("array<double>") for c in (conf_a, conf_b)]
    both = F.struct(points[0].alias("a"), points[1].alias("b"), _sure(a, confs[0], least).alias("ga"), _sure(b, confs[1], least).alias("gb"))
    whole = F.coalesce((F.size(a) >= JOINTS) & (F.size(b) >= JOINTS), F.lit(False))
    return F.when(whole, once(both, lambda s: F.greatest(F.lit(0.0), _cosine(s, False), _cosine(s, True)))).otherwise(F.lit(0.0))


def pose_cost(similarity: Column) -> Column:
    return (F.lit(1.0) - similarity) / 2
