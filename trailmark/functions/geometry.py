"""Keypoints, boxes and crops as column expressions.

Points are arrays of (x, y), confidences an array beside them, boxes arrays of
x1, y1, x2, y2. A null or unusable value gives null; coordinates that are not
there are NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.vectors import global_ssim, once, unit

#: Joints of the 25-point body layout.
NECK, R_ELBOW, R_WRIST, L_ELBOW, L_WRIST, MID_HIP, R_HIP, R_KNEE, L_HIP, L_KNEE = 1, 3, 4, 6, 7, 8, 9, 10, 12, 13
JOINTS = 25
#: Left and right joints whose labels are swapped.
SWAPS = ((2, 5), (3, 6), (9, 12), (10, 13))

NAN = float("nan")


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _finite_point(p: Column) -> Column:
    return finite(p[0]) & finite(p[1])


# ---------------------------------------------------------------- coercions


def points_of(flat: Column) -> Column:
    """A flat list x, y, x, y, ... as points; a last value without a partner is dropped."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(flat, i * 2), F.get(flat, i * 2 + 1)))).otherwise(F.array().cast("array<array<double>>"))


def confidences(points: Column, conf: Column) -> Column:
    """As many confidences as points: cut, or filled up with 0; all 1 where there are none."""
    places = F.sequence(F.lit(1), F.size(points))
    return F.when(F.size(points) > 0, F.when(conf.isNull(), F.transform(points, lambda _: F.lit(1.0))).otherwise(F.transform(places, lambda i: F.coalesce(F.try_element_at(conf, i).cast("double"), F.lit(0.0)))))


def finite_list(values: Column) -> Column:
    """The list as doubles; null if it is empty or has a value that is not finite."""
    return F.when((F.size(values) > 0) & F.forall(values, lambda x: finite(x)), F.transform(values, lambda x: x.cast("double")))


def bool_list(values: Column) -> Column:
    """Numbers as whether they are other than 0 (what is no number is; null counts as none)."""
    return F.transform(values, lambda x: F.coalesce(x.cast("double") != 0, F.lit(False)))


def pair_list(values: Column) -> Column:
    """Points as their first two numbers; null where one has fewer."""
    return F.when(F.forall(values, lambda p: F.size(p) >= 2), F.transform(values, lambda p: F.array(p[0].cast("double"), p[1].cast("double"))))


def relations_json(relations: Column) -> Column:
    return F.coalesce(F.to_json(relations), F.lit("[]"))


def relations_of(text: Column, schema: str) -> Column:
    """The relations of a JSON text; empty where it cannot be read."""
    return F.coalesce(F.from_json(text, schema), F.array().cast(schema))


def posed(points: Column, conf: Column, least: float = 0.05) -> Column:
    """Points of too little confidence become NaN; null where the lengths differ."""
    nothing = F.array(F.lit(NAN), F.lit(NAN))
    kept = F.when(conf.isNull(), points).otherwise(F.zip_with(points, conf, lambda p, c: F.when(F.coalesce(c >= least, F.lit(False)), p).otherwise(nothing)))
    return F.when(conf.isNull() | (F.size(points) == F.size(conf)), kept)


def keypoints25(points: Column, conf: Column) -> Column:
    """25 triples x, y, confidence: NaN and 0 where missing, an error where there are more or fewer."""

    def checked(value: Column, missing: Column, kind: str) -> Column:
        wrong = F.raise_error(F.format_string("expected 25 keypoints, received %d", F.size(value))).cast(kind)
        return F.when(value.isNull(), missing).when(F.size(value) == JOINTS, value.cast(kind)).otherwise(wrong)

    xy = checked(points, F.array_repeat(F.array(F.lit(NAN), F.lit(NAN)), JOINTS), "array<array<double>>")
    return F.zip_with(xy, checked(conf, F.array_repeat(F.lit(0.0), JOINTS), "array<double>"), lambda p, c: F.array(p[0], p[1], c))


# ---------------------------------------------------------------- poses


def mean_confidence(conf: Column) -> Column:
    """Mean of the values that are numbers; null without any."""
    good = F.filter(conf, lambda c: c.isNotNull() & ~F.isnan(c))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, c: s + c.cast("double")) / F.size(good))


def _median(values: Column) -> Column:
    good = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(good)
    middle = (F.get(good, F.floor((n - 1) / 2).cast("int")) + F.get(good, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


def torso_center(points: Column) -> Column:
    """Median of neck and middle hip, axis by axis; of all joints where neither is there."""
    torso = F.array(F.get(points, F.lit(NECK)), F.get(points, F.lit(MID_HIP)))
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    some = F.exists(torso, lambda p: there(p[0]) | there(p[1]))
    used = F.when(some, torso).otherwise(points)
    return F.array(_median(F.transform(used, lambda p: p[0])), _median(F.transform(used, lambda p: p[1])))


def bone_directions(points: Column, bones: tuple[tuple[int, int], ...]) -> Column:
    """The direction of each bone from its first to its second joint."""

    def one(a: int, b: int) -> Column:
        dx, dy = points[b][0] - points[a][0], points[b][1] - points[a][1]
        length = F.sqrt(dx * dx + dy * dy) + F.lit(1e-9)
        return F.array(dx / length, dy / length)

    return F.array(*(one(a, b) for a, b in bones))


def swapped_sides(values: Column) -> Column:
    """The list with left and right joints exchanged (wrists and ankles stay)."""
    order = list(range(JOINTS))
    for a, b in SWAPS:
        order[a], order[b] = b, a
    return F.transform(F.array(*(F.lit(i) for i in order)), lambda i: F.get(values, i))


def any_visible(conf: Column) -> Column:
    return F.coalesce(F.exists(conf, lambda c: F.coalesce(c > 0, F.lit(False))), F.lit(False))


# ---------------------------------------------------------------- boxes


def sane_box(box: Column) -> Column:
    """The box if its four values are finite and it has an extent."""
    good = (F.size(box) == 4) & F.forall(box, finite) & (box[2] > box[0]) & (box[3] > box[1])
    return F.when(F.coalesce(good, F.lit(False)), F.transform(box, lambda x: x.cast("double")))


def _within(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(x.cast("bigint"), most))


def _inside(values: list[Column], width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = (_within(v, m) for v, m in zip(values, (width - 1, height - 1, width, height), strict=True))
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def clip_to_image(box: Column, width: Column, height: Column) -> Column:
    """Truncated to whole pixels, then kept within the image; null where nothing is left."""
    return once(F.transform(box, lambda x: x.cast("bigint")), lambda b: _inside([b[i] for i in range(4)], width.cast("bigint"), height.cast("bigint")))


def crop_box(box: Column, width: Column, height: Column) -> Column:
    """Rounded (halves to even), then kept within the image; null where nothing is left."""
    return once(F.transform(box, lambda x: F.bround(x).cast("bigint")), lambda b: _inside([b[i] for i in range(4)], width.cast("bigint"), height.cast("bigint")))


def expand_box(box: Column, width: Column, height: Column, by_width: float = 0.10, by_height: float = 0.15) -> Column:
    """Wider and higher around its centre, rounded and clipped."""

    def grown(b: Column) -> Column:
        w, h, cx, cy = b[2] - b[0], b[3] - b[1], (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        dx, dy = w * F.lit(1 + by_width) / 2, h * F.lit(1 + by_height) / 2
        return F.when((w > 0) & (h > 0), crop_box(F.array(cx - dx, cy - dy, cx + dx, cy + dy), width, height))

    return once(box, grown)


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes share an area."""
    return (a[2] > b[0]) & (b[2] > a[0]) & (a[3] > b[1]) & (b[3] > a[1])


def keypoint_box(points: Column, conf: Column, least: float = 0.1, width: Column | None = None, height: Column | None = None) -> Column:
    """Whole pixels around the points of enough confidence, within the image if it
    is given; null where nothing or no extent is left."""
    good = F.filter(F.arrays_zip(points.alias("p"), conf.alias("c")), lambda z: F.coalesce(z["c"] >= least, F.lit(False)) & _finite_point(z["p"]))
    xs, ys = F.transform(good, lambda z: z["p"][0]), F.transform(good, lambda z: z["p"][1])

    def sized(b: Column) -> Column:
        most = [width, height, width, height]
        v = [b[i] if m is None else F.greatest(F.lit(0.0), F.least(m.cast("double") - 1, b[i])) for i, m in enumerate(most)]
        return F.when((v[2] > v[0]) & (v[3] > v[1]), F.array(*(x.cast("bigint") for x in v)))

    return once(F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), sized)


def intersection_box(inter: Column, box: Column) -> Column:
    """The box that overlaps are taken of: its own where given, else the plain one."""
    return sane_box(F.coalesce(inter, box))


def box_or_keypoints(box: Column, points: Column, conf: Column, width: Column, height: Column, least: float = 0.05) -> Column:
    """The box within the image, else the one around the keypoints."""
    given = F.when(F.coalesce(F.forall(box, finite), F.lit(False)), clip_to_image(box, width, height))
    return F.coalesce(given, keypoint_box(points, confidences(points, conf), least, width, height))


def padded_box(box: Column, observed: Column) -> Column:
    """Four NaN where there is no observation."""
    return F.when(observed, box).otherwise(F.array_repeat(F.lit(NAN), 4))


def box_size(box: Column) -> Column:
    return F.struct((box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"))


# ---------------------------------------------------------------- crops


def _sure(conf: Column, least: float, *joints: int) -> Column:
    ok = F.lit(True)
    for j in joints:
        ok = ok & F.coalesce(F.get(conf, F.lit(j)) >= least, F.lit(False))
    return ok


def glove_box(points: Column, conf: Column, elbow: int, wrist: int, width: Column, height: Column, least: float = 0.2, shift: float = 0.25, size: float = 1.35) -> Column:
    """A square beyond the wrist, on the scale of the forearm."""
    ex, ey, wx, wy = points[elbow][0], points[elbow][1], points[wrist][0], points[wrist][1]
    dx, dy = wx - ex, wy - ey
    length = F.sqrt(dx * dx + dy * dy)
    half = length * F.lit(size / 2)
    cx, cy = wx + dx * F.lit(shift), wy + dy * F.lit(shift)
    return F.when(_sure(conf, least, elbow, wrist) & (length >= 1e-6), crop_box(F.array(cx - half, cy - half, cx + half, cy + half), width, height))


def shorts_box(points: Column, conf: Column, width: Column, height: Column, least: float = 0.2, wide: float = 1.5, lift: float = 0.35, knees: float = 0.45, fallback: float = 0.9) -> Column:
    """Around the middle hip, on the scale of the hips, down towards the knees where they are seen."""
    dx, dy = points[L_HIP][0] - points[R_HIP][0], points[L_HIP][1] - points[R_HIP][1]
    hips = F.sqrt(dx * dx + dy * dy)
    mx, my = points[MID_HIP][0], points[MID_HIP][1]
    knee = (points[R_KNEE][1] + points[L_KNEE][1]) * F.lit(0.5)
    bottom = F.when(_sure(conf, least, R_KNEE, L_KNEE), my + (knee - my) * F.lit(knees)).otherwise(my + hips * F.lit(fallback))
    half = hips * F.lit(wide / 2)
    return F.when(_sure(conf, least, MID_HIP, R_HIP, L_HIP) & (hips >= 1e-6), crop_box(F.array(mx - half, my - hips * F.lit(lift), mx + half, bottom), width, height))


def crop_boxes(points: Column, conf: Column, width: Column, height: Column, least: float = 0.4) -> Column:
    """Both gloves and the shorts of a person."""
    left = glove_box(points, conf, L_ELBOW, L_WRIST, width, height, least)
    right = glove_box(points, conf, R_ELBOW, R_WRIST, width, height, least)
    return F.struct(left.alias("left_glove"), right.alias("right_glove"), shorts_box(points, conf, width, height, least).alias("shorts"))


# ---------------------------------------------------------------- names, vectors, images


def pair_number(name: Column) -> Column:
    """The number that starts a file's name, as text; null without one."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))


def pair_weight(name: Column) -> Column:
    """Hundredths after ``__w_`` at the end of a file's stem; 1 without them."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = F.nullif(F.regexp_extract(stem, r"__w_(\d+)$", 1), F.lit(""))
    return F.coalesce(found.cast("double") / 100, F.lit(1.0))


def unit_distance(a: Column, b: Column) -> Column:
    """Distance of two vectors, each scaled to length 1 first."""
    return F.sqrt(F.aggregate(F.zip_with(unit(a), unit(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def block_ssim(a: Column, b: Column, height: int, width: int, rows: int, columns: int, least: int = 16) -> Column:
    """Mean similarity over a grid of blocks of two row-major images; a block under
    ``least`` pixels adds 0 but counts."""

    def edges(n: int, parts: int) -> list[int]:
        return [n * i // parts for i in range(parts + 1)]

    total = F.lit(0.0)
    ys, xs = edges(height, rows), edges(width, columns)
    for y0, y1 in zip(ys[:-1], ys[1:], strict=True):
        for x0, x1 in zip(xs[:-1], xs[1:], strict=True):
            if (y1 - y0) * (x1 - x0) >= least:
                block = [F.concat(*(F.slice(v, y * width + x0 + 1, x1 - x0) for y in range(y0, y1))) for v in (a, b)]
                total = total + global_ssim(*block)
    return total / max(1, rows * columns)

