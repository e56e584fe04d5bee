"""Queries of keypoints, boxes, crops and detection rows.

The 64 numbers of an embedding stand in for a person: 25 points, shifted and
scaled into a small image, and 25 confidences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import geometry as G
from trailmark.functions import vectors as V
from trailmark.operators import detections as D
from trailmark.operators import skeleton
from trailmark.plans.catalogue import OBS, obs, query, table

PEOPLE = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT vec_id, e, list_transform(range(25), lambda i: [100 * (1 + e[2 * i + 1]), 100 * (1 + e[2 * i + 2])]) AS kp, list_transform(range(25), lambda i: 4 * abs(e[i + 30])) AS conf FROM e)
"""


def people(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    places = F.sequence(F.lit(0), F.lit(24))
    kp = F.transform(places, lambda i: F.array((F.get("e", i * 2) + 1) * 100, (F.get("e", i * 2 + 1) + 1) * 100))
    return e.select("vec_id", "e", kp.alias("kp"), F.transform(places, lambda i: F.abs(F.get("e", i + 29)) * 4).alias("conf"))


def _rounded(v: Column) -> Column:
    return F.transform(v, lambda x: V.rounded(x))


# ------------------------------------------------------------- poses


@query(PEOPLE + "SELECT vec_id, round(list_avg(conf), 6) AS mean_conf, len(list_filter(conf, lambda c: c > 0)) > 0 AS visible FROM p")
def q_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("vec_id", F.round(G.mean_confidence(F.col("conf")), 6).alias("mean_conf"), G.any_visible(F.col("conf")).alias("visible"))


@query(PEOPLE + """, s AS (SELECT vec_id, kp, list_filter(range(1, 26), lambda i: conf[i] >= 0.3) AS sure FROM p),
u AS (SELECT vec_id, kp, CASE WHEN len(list_filter(sure, lambda i: i IN (2, 9))) > 0 THEN list_filter(sure, lambda i: i IN (2, 9)) ELSE sure END AS used FROM s)
SELECT vec_id, round(list_median(list_transform(used, lambda i: kp[i][1])), 6) AS x, round(list_median(list_transform(used, lambda i: kp[i][2])), 6) AS y FROM u""")
def q_torso_center(spark: SparkSession, d: str) -> DataFrame:
    """Centres of poses whose unsure points are taken as missing."""
    c = people(spark, d).select("vec_id", G.torso_center(G.posed(F.col("kp"), F.col("conf"), 0.3)).alias("c"))
    return c.select("vec_id", F.round(F.col("c")[0], 6).alias("x"), F.round(F.col("c")[1], 6).alias("y"))


@query(PEOPLE + "SELECT vec_id, round(list_sum(list_transform(kp, lambda q: q[1] - kp[9][1])), 6) AS x, round(list_sum(list_transform(kp, lambda q: q[2] - kp[9][2])), 6) AS y FROM p")
def q_pose_centred(spark: SparkSession, d: str) -> DataFrame:
    c = people(spark, d).select("vec_id", V.centred(F.col("kp"), G.MID_HIP).alias("c"))

    def total(axis: int) -> Column:
        return V.rounded(F.aggregate("c", F.lit(0.0), lambda s, p: s + p[axis]))

    return c.select("vec_id", total(0).alias("x"), total(1).alias("y"))


_BONES = ((1, 2), (2, 3), (1, 5), (8, 9))
_BONE = "[round((kp[{1}][1] - kp[{0}][1]) / (sqrt((kp[{1}][1] - kp[{0}][1]) ** 2 + (kp[{1}][2] - kp[{0}][2]) ** 2) + 1e-9), 6), round((kp[{1}][2] - kp[{0}][2]) / (sqrt((kp[{1}][1] - kp[{0}][1]) ** 2 + (kp[{1}][2] - kp[{0}][2]) ** 2) + 1e-9), 6)]"


@query(PEOPLE + f"SELECT vec_id, list_concat({', '.join(_BONE.format(a + 1, b + 1) for a, b in _BONES)}) AS directions FROM p")
def q_bone_directions(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("vec_id", _rounded(F.flatten(G.bone_directions(F.col("kp"), _BONES))).alias("directions"))


@query(PEOPLE + "SELECT vec_id, list_transform([1, 2, 6, 7, 5, 3, 4, 8, 9, 13, 14, 12, 10, 11, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25], lambda i: round(conf[i], 6)) AS conf FROM p")
def q_swapped_sides(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("vec_id", _rounded(G.swapped_sides(F.col("conf"))).alias("conf"))


@query(PEOPLE + "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 25 ELSE 0 END AS BIGINT) AS n_missing, round(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE list_sum(conf) END, 6) AS conf, CAST(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE len(list_filter(conf, lambda c: c > 0)) END AS BIGINT) AS n_visible FROM p")
def q_keypoints25(spark: SparkSession, d: str) -> DataFrame:
    some = people(spark, d).select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("kp")).alias("kp"), F.when(F.col("vec_id") % 4 != 0, F.col("conf")).alias("conf"))
    k = some.select("vec_id", G.keypoints25(F.col("kp"), F.col("conf")).alias("k"))
    return k.select(
        "vec_id",
        F.size(F.filter("k", lambda p: F.isnan(p[0]))).cast("bigint").alias("n_missing"),
        F.round(F.aggregate("k", F.lit(0.0), lambda s, p: s + p[2]), 6).alias("conf"),
        F.size(F.filter("k", lambda p: p[2] > 0)).cast("bigint").alias("n_visible"),
    )


@query(PEOPLE + "SELECT vec_id, list_transform(range(25), lambda i: round(e[2 * i + 1] + e[2 * i + 2], 6)) AS sums, list_transform(range(25), lambda i: CASE WHEN i < 20 THEN round(conf[i + 1], 6) ELSE 0 END) AS conf FROM p")
def q_coerced_keypoints(spark: SparkSession, d: str) -> DataFrame:
    """51 flat values are 25 points; 20 confidences are filled up with zeros."""
    c = people(spark, d).select("vec_id", G.points_of(F.slice("e", 1, 51)).alias("kp"), F.slice("conf", 1, 20).alias("conf"))
    return c.select("vec_id", _rounded(F.transform("kp", lambda p: p[0] + p[1])).alias("sums"), _rounded(G.confidences(F.col("kp"), F.col("conf"))).alias("conf"))


@query(PEOPLE + "SELECT vec_id, CASE WHEN vec_id % 4 <> 0 THEN list_transform(list_slice(e, 1, 4), lambda x: round(x, 6)) END AS v FROM p")
def q_finite_list(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 8 == 0, F.array(F.lit(1.0), F.lit(float("nan")))).when(F.col("vec_id") % 8 == 4, F.slice("e", 1, 0)).otherwise(F.slice("e", 1, 4))
    return people(spark, d).select("vec_id", _rounded(G.finite_list(v)).alias("v"))


# ------------------------------------------------------------- boxes and crops


def _inside(x1: str, y1: str, x2: str, y2: str, width: int, height: int) -> str:
    """SQL of a box of whole numbers kept within an image."""
    v = [f"greatest(0, least({m}, CAST({x} AS BIGINT)))" for x, m in ((x1, width - 1), (y1, height - 1), (x2, width), (y2, height))]
    return f"CASE WHEN {v[2]} > {v[0]} AND {v[3]} > {v[1]} THEN [{', '.join(v)}] END"


@query(PEOPLE + """, s AS (SELECT vec_id, list_filter(list_zip(kp, conf), lambda z: z[2] >= 0.3) AS z FROM p),
b AS (SELECT vec_id, greatest(0, least(109, list_min(list_transform(z, lambda q: q[1][1])))) AS x1, greatest(0, least(104, list_min(list_transform(z, lambda q: q[1][2])))) AS y1,
  greatest(0, least(109, list_max(list_transform(z, lambda q: q[1][1])))) AS x2, greatest(0, least(104, list_max(list_transform(z, lambda q: q[1][2])))) AS y2 FROM s WHERE len(z) > 0)
SELECT vec_id, CASE WHEN x2 > x1 AND y2 > y1 THEN [CAST(trunc(x1) AS BIGINT), CAST(trunc(y1) AS BIGINT), CAST(trunc(x2) AS BIGINT), CAST(trunc(y2) AS BIGINT)] END AS box FROM p LEFT JOIN b USING (vec_id)""")
def q_keypoint_box(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("vec_id", G.keypoint_box(F.col("kp"), F.col("conf"), 0.3, F.lit(110), F.lit(105)).alias("box"))


_E = {"x1": "round_even((a + b) / 2 - (b - a) * 0.55, 0)", "y1": "round_even((5.5 + 61.5) / 2 - 56 * 0.575, 0)", "x2": "round_even((a + b) / 2 + (b - a) * 0.55, 0)", "y2": "round_even((5.5 + 61.5) / 2 + 56 * 0.575, 0)"}


@query(f"""WITH v AS (SELECT event_id, value - 20 AS a, value * 1.25 - 40 AS b FROM events)
SELECT event_id, b > a AS sane, {_inside("trunc(a)", "trunc(5.5)", "trunc(b)", "trunc(61.5)", 300, 60)} AS clipped,
{_inside("round_even(a, 0)", "round_even(5.5, 0)", "round_even(b, 0)", "round_even(61.5, 0)", 300, 60)} AS crop,
CASE WHEN b > a THEN {_inside(_E["x1"], _E["y1"], _E["x2"], _E["y2"], 300, 60)} END AS grown, 100 > a AND b > 50 AS meets FROM v""")
def q_box_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, h, box = F.lit(300), F.lit(60), F.col("box")
    v = table(spark, d, "events").select("event_id", F.array(F.col("value") - 20, F.lit(5.5), F.col("value") * 1.25 - 40, F.lit(61.5)).alias("box"))
    meets = G.boxes_meet(box, F.array(F.lit(50.0), F.lit(0.0), F.lit(100.0), F.lit(60.0)))
    return v.select("event_id", G.sane_box(box).isNotNull().alias("sane"), G.clip_to_image(box, w, h).alias("clipped"), G.crop_box(box, w, h).alias("crop"), G.expand_box(box, w, h).alias("grown"), meets.alias("meets"))


def _glove(elbow: int, wrist: int) -> str:
    e, w = f"kp[{elbow + 1}]", f"kp[{wrist + 1}]"
    length = f"sqrt(({w}[1] - {e}[1]) ** 2 + ({w}[2] - {e}[2]) ** 2)"
    at = [f"({w}[{k}] + 0.25 * ({w}[{k}] - {e}[{k}]))" for k in (1, 2)]
    box = [f"round_even({c} {s} 0.675 * {length}, 0)" for s in "-+" for c in at]
    return f"CASE WHEN conf[{elbow + 1}] >= 0.4 AND conf[{wrist + 1}] >= 0.4 AND {length} >= 1e-6 THEN {_inside(*box, 200, 200)} END"


_HIPS = "sqrt((kp[13][1] - kp[10][1]) ** 2 + (kp[13][2] - kp[10][2]) ** 2)"
_BOTTOM = f"CASE WHEN conf[11] >= 0.4 AND conf[14] >= 0.4 THEN kp[9][2] + 0.45 * (0.5 * (kp[11][2] + kp[14][2]) - kp[9][2]) ELSE kp[9][2] + 0.9 * {_HIPS} END"
_SHORTS = _inside(f"round_even(kp[9][1] - 0.75 * {_HIPS}, 0)", f"round_even(kp[9][2] - 0.35 * {_HIPS}, 0)", f"round_even(kp[9][1] + 0.75 * {_HIPS}, 0)", f"round_even({_BOTTOM}, 0)", 200, 200)


@query(PEOPLE + f"SELECT vec_id, {_glove(6, 7)} AS left_glove, {_glove(3, 4)} AS right_glove, CASE WHEN conf[9] >= 0.4 AND conf[10] >= 0.4 AND conf[13] >= 0.4 AND {_HIPS} >= 1e-6 THEN {_SHORTS} END AS shorts FROM p")
def q_crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("vec_id", G.crop_boxes(F.col("kp"), F.col("conf"), F.lit(200), F.lit(200)).alias("c")).select("vec_id", "c.*")


@query("SELECT event_id, event_type = 'view' AS observed, event_type <> 'view' AS padded, CASE WHEN event_type = 'view' THEN 30::double ELSE -1 END AS width, CASE WHEN event_type = 'view' THEN 40::double ELSE -1 END AS height FROM events")
def q_padded_box(spark: SparkSession, d: str) -> DataFrame:
    """The size of a box; -1 for the NaN of one without an observation."""
    observed = F.col("event_type") == "view"
    box = G.padded_box(F.array(F.lit(10.0), F.lit(20.0), F.lit(40.0), F.lit(60.0)), observed)
    return table(spark, d, "events").select("event_id", observed.alias("observed"), F.isnan(box[0]).alias("padded"), G.box_size(box).alias("s")).select("event_id", "observed", "padded", *(F.nanvl(f"s.{c}", F.lit(-1.0)).alias(c) for c in ("width", "height")))


# ------------------------------------------------------------- names, vectors, images


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'x' ELSE lpad(CAST(l_orderkey AS VARCHAR), 6, '0') END || '__neg' || CASE WHEN l_linenumber % 2 = 0 THEN '__w_' || (l_partkey % 400) ELSE '' END || '.jpg' AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, nullif(regexp_extract(name, '^([0-9]+)', 1), '') AS pair_id, coalesce(CAST(nullif(regexp_extract(name, '__w_([0-9]+)[.]jpg$', 1), '') AS DOUBLE) / 100, 1) AS weight FROM n""")
def q_pair_names(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("l_linenumber") == 7, "x").otherwise(F.lpad(F.col("l_orderkey").cast("string"), 6, "0"))
    weight = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("__w_"), (F.col("l_partkey") % 400).cast("string"))).otherwise("")
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(number, F.lit("__neg"), weight, F.lit(".jpg")).alias("name"))
    return n.select("l_orderkey", "l_linenumber", G.pair_number(F.col("name")).alias("pair_id"), G.pair_weight(F.col("name")).alias("weight"))


@query("SELECT a.vec_id, round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_embedding_distance(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "embeddings").alias("a"), table(spark, d, "embeddings").alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), F.round(G.unit_distance(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))


_SSIM = "(2 * list_avg({0}) * list_avg({1}) + 1e-4) * (2 * (list_dot_product({0}, {1}) / 16 - list_avg({0}) * list_avg({1})) + 9e-4) / ((list_avg({0}) ** 2 + list_avg({1}) ** 2 + 1e-4) * (list_dot_product({0}, {0}) / 16 - list_avg({0}) ** 2 + list_dot_product({1}, {1}) / 16 - list_avg({1}) ** 2 + 9e-4))"
_BLOCKS = [[f"list_slice({{0}}, {(y + r) * 8 + x + 1}, {(y + r) * 8 + x + 4})" for r in range(4)] for y in (0, 4) for x in (0, 4)]
_AT = [f"list_concat({', '.join(b)})" for b in _BLOCKS]


@query(f"""WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
q AS (SELECT vec_id, {', '.join(f"{t.format(v)} AS {v}{i}" for i, t in enumerate(_AT) for v in "xy")} FROM p)
SELECT vec_id, round(({' + '.join(_SSIM.format(f"x{i}", f"y{i}") for i in range(4))}) / 4, 6) AS ssim FROM q""")
def q_block_ssim(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "embeddings").alias("a"), table(spark, d, "embeddings").alias("b")
    pairs = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return pairs.select(F.col("a.vec_id").alias("vec_id"), F.round(G.block_ssim(F.col("a.embedding"), F.col("b.embedding"), 8, 8, 2, 2), 6).alias("ssim"))


@query("SELECT event_id, CAST(CASE user_id % 3 WHEN 0 THEN 0 ELSE 2 END AS BIGINT) AS n_relations, CASE user_id % 3 WHEN 0 THEN '[]' ELSE '[{\"det_idx\":' || user_id || ',\"iou\":0.5},{\"det_idx\":7,\"iou\":0.25}]' END AS relations FROM events")
def q_relations_json(spark: SparkSession, d: str) -> DataFrame:
    """Relations read from JSON, empty where it is damaged or missing, and written again."""
    text = F.when(F.col("user_id") % 3 != 0, F.format_string('[{"det_idx": %d, "iou": 0.5}, {"det_idx": 7, "iou": 0.25}]', "user_id")).when(F.col("event_type") == "view", "[{damaged")
    found = G.relations_of(text, "array<struct<det_idx: bigint, iou: double>>")
    return table(spark, d, "events").select("event_id", F.size(found).cast("bigint").alias("n_relations"), G.relations_json(found).alias("relations"))


# ------------------------------------------------------------- detection rows

DETECTED = OBS + ", d AS (SELECT frame_idx, event_id AS det_id, bbox_x1 AS center_x, CAST(local_track_id AS DOUBLE) AS center_y FROM obs)\n"


def detected(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).select("frame_idx", F.col("event_id").alias("det_id"), F.col("bbox_x1").alias("center_x"), F.col("local_track_id").cast("double").alias("center_y"))


@query(DETECTED + "SELECT a.frame_idx, a.det_id, round(min(sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2)) / 200, 6) AS center_dist_norm_min, coalesce(min(sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2)) / 200 <= 0.0123, false) AS center_dist_overlap_risk FROM d a LEFT JOIN d b ON a.frame_idx = b.frame_idx AND a.det_id <> b.det_id GROUP BY ALL")
def q_center_risk(spark: SparkSession, d: str) -> DataFrame:
    return D.center_risk(detected(spark, d), 200.0, 0.0123).withColumn("center_dist_norm_min", F.round("center_dist_norm_min", 6))


@query(DETECTED + """, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY det_id) - 1 AS place FROM d),
n AS (SELECT b.frame_idx, b.place, min((sqrt((a.center_x - b.center_x) ** 2 + (a.center_y - b.center_y) ** 2), a.place)) AS n FROM r b JOIN r a ON a.frame_idx = b.frame_idx AND a.place < 3 WHERE b.place >= 3 GROUP BY ALL),
c AS (SELECT frame_idx, place FROM n QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY n, place) <= 3)
SELECT frame_idx, det_id, place FROM r WHERE place < 3 OR (frame_idx, place) IN (SELECT (frame_idx, place) FROM c)""")
def q_top_with_nearest(spark: SparkSession, d: str) -> DataFrame:
    return D.top_with_nearest(detected(spark, d)).select("frame_idx", "det_id", "place")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select(F.floor(F.col("vec_id") / 8).alias("frame_idx"), F.col("vec_id").alias("det_id"), F.col("kp").alias("keypoints"), F.col("conf").alias("kp_conf"), "e")


_VALUES = lambda bones: ", ".join(f"({i}, {j})" for i, j in bones)


@query(PEOPLE + f""", joints AS (SELECT vec_id, i, kp[i + 1][1] AS x, kp[i + 1][2] AS y FROM p, range(25) AS t(i) WHERE conf[i + 1] >= 0.4),
boxes AS (SELECT vec_id, vec_id // 8 AS frame, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM joints GROUP BY vec_id),
sized AS (SELECT *, x2 > x1 AND y2 > y1 AS sane FROM boxes),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, least(CASE WHEN a.sane THEN a.x1 END, CASE WHEN b.sane THEN b.x1 END) - 21 AS ox, least(CASE WHEN a.sane THEN a.y1 END, CASE WHEN b.sane THEN b.y1 END) - 21 AS oy,
  CASE WHEN a.sane AND b.sane THEN sqrt(((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2) / ((sqrt((a.x2 - a.x1) * (a.y2 - a.y1)) + sqrt((b.x2 - b.x1) * (b.y2 - b.y1))) / 2) ELSE 'inf'::DOUBLE END AS away
  FROM sized a JOIN sized b ON b.frame = a.frame AND b.vec_id > a.vec_id),
bones AS (SELECT 0 AS kind, * FROM (VALUES {_VALUES(skeleton.FULL)}) AS t(i, j) UNION ALL SELECT 1, * FROM (VALUES {_VALUES(skeleton.TRUNK)}) AS t(i, j)),
ends AS (SELECT a, b, side, kind, CAST(round_even(f.x - ox, 0) AS BIGINT) AS px, CAST(round_even(f.y - oy, 0) AS BIGINT) AS py, CAST(round_even(t.x - ox, 0) AS BIGINT) AS qx, CAST(round_even(t.y - oy, 0) AS BIGINT) AS qy
  FROM pairs, (VALUES (0), (1)) AS s(side), bones JOIN joints f ON f.i = bones.i JOIN joints t ON t.i = bones.j AND t.vec_id = f.vec_id WHERE f.vec_id = CASE WHEN side = 0 THEN a ELSE b END),
lines AS (SELECT *, unnest(range(least(py, qy) - 3, greatest(py, qy) + 4)) AS y FROM ends),
cells AS (SELECT *, unnest(range(least(px, qx) - 3, greatest(px, qx) + 4)) AS x FROM lines),
dots AS (SELECT DISTINCT a, b, side, kind, x, y FROM cells WHERE 4 * ((x - px) ** 2 + (y - py) ** 2) <= 49 OR 4 * ((x - qx) ** 2 + (y - qy) ** 2) <= 49
  OR ((x - px) * (qx - px) + (y - py) * (qy - py) BETWEEN 0 AND (qx - px) ** 2 + (qy - py) ** 2 AND 4 * ((x - px) * (qy - py) - (y - py) * (qx - px)) ** 2 <= 49 * ((qx - px) ** 2 + (qy - py) ** 2) AND (qx <> px OR qy <> py))),
counts AS (SELECT a, b, kind, count(*) AS n FROM dots GROUP BY ALL), seen AS (SELECT DISTINCT a, b, kind, x, y FROM dots), wholes AS (SELECT a, b, kind, count(*) AS u FROM seen GROUP BY ALL),
ious AS (SELECT a, b, sum(CASE kind WHEN 0 THEN 0.35 ELSE 0.65 END * (n - u) / u) AS iou FROM counts JOIN wholes USING (a, b, kind) GROUP BY ALL),
people AS (SELECT vec_id AS id, vec_id // 8 AS frame FROM p),
whole AS (SELECT x.frame, x.id AS a, y.id AS b, coalesce(iou, 0) AS iou, coalesce(away, 'inf'::DOUBLE) AS away FROM people x JOIN people y ON y.frame = x.frame AND y.id > x.id LEFT JOIN ious ON ious.a = x.id AND ious.b = y.id LEFT JOIN pairs ON pairs.a = x.id AND pairs.b = y.id),
ways AS (SELECT frame, a AS det_id, b AS other_id, round(iou, 9) AS iou, round(away, 9) AS away FROM whole UNION ALL SELECT frame, b, a, round(iou, 9), round(away, 9) FROM whole)
SELECT frame AS frame_idx, det_id, round(max(iou), 6) AS max_overlap_iou, CASE WHEN max(iou) > 0 THEN arg_max(other_id, (iou, -other_id)) END AS max_overlap_det_idx,
  round(min(away), 6) AS min_center_dist_norm, arg_min(other_id, (away, other_id)) AS center_dist_norm_det_idx FROM ways GROUP BY ALL""")
def q_skeleton_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The strongest overlap of each drawn skeleton with another of its frame, and its nearest neighbour."""
    from trailmark.operators.export import overlap_extrema

    pairs = skeleton.skeleton_pairs(_frames(spark, d), least=0.4).withColumns({c: F.round(c, 9) for c in ("iou", "center_dist_norm")})
    return overlap_extrema(pairs).withColumns({c: F.round(c, 6) for c in ("max_overlap_iou", "min_center_dist_norm")})


@query(PEOPLE + """, k AS (SELECT vec_id, list_filter(list_zip(kp, conf), lambda z: z[2] >= 0.1) AS z, conf FROM p)
SELECT vec_id // 8 AS frame_idx, vec_id AS det_id, trunc(list_min(list_transform(z, lambda q: q[1][1]))) AS bbox_x1, trunc(list_max(list_transform(z, lambda q: q[1][2]))) AS bbox_y2, round(list_avg(conf), 6) AS confidence,
  (vec_id % 8) // 3 AS crop_shard_id, (vec_id % 8) % 3 AS crop_index FROM k""")
def q_raw_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.raw_rows(_frames(spark, d), shard_size=3).select("frame_idx", "det_id", "bbox_x1", "bbox_y2", F.round("confidence", 6).alias("confidence"), "crop_shard_id", "crop_index")


@query(PEOPLE + """SELECT vec_id AS det_id, vec_id % 3 <> 0 AS has_valid_bbox, vec_id % 5 <> 0 AS has_e_app, CAST(CASE WHEN vec_id % 2 = 0 THEN 25 ELSE 20 END AS BIGINT) AS n_points,
  round(CASE WHEN vec_id % 7 = 0 THEN conf[1] WHEN vec_id % 3 <> 0 THEN 30 ELSE list_avg(list_transform(list_slice(kp, 1, CASE WHEN vec_id % 2 = 0 THEN 25 ELSE 20 END), lambda q: q[1])) END, 6) AS center_x FROM p""")
def q_prepared_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Detections stored as rows and read back: what is not finite is gone, a
    missing centre is the box's or the points'."""
    k = F.col("det_id")
    found = _frames(spark, d).select(
        "frame_idx", "det_id", "keypoints",
        F.when(k % 2 == 0, F.col("kp_conf")).otherwise(F.slice("kp_conf", 1, 20)).alias("kp_conf"),
        F.when(k % 3 != 0, F.array(*(F.lit(float(v)) for v in (20, 30, 40, 60)))).otherwise(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0), F.lit(3.0))).alias("bbox"),
        F.when(k % 5 != 0, F.col("e")).alias("e_app"), F.when(k % 7 == 0, F.col("kp_conf")[0]).alias("center_x"), F.lit(1.0).alias("center_y"),
    )
    back = D.restored(D.prepared_rows(found))
    return back.select("det_id", "has_valid_bbox", "has_e_app", F.size("keypoints").cast("bigint").alias("n_points"), F.round("center_x", 6).alias("center_x"))


@query(PEOPLE + """, k AS (SELECT vec_id, list_filter(list_zip(kp, conf), lambda z: z[2] >= 0.4) AS z FROM p),
b AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN [20, 30, 40, 60] WHEN len(z) > 0 AND least(109, list_max(list_transform(z, lambda q: q[1][1]))) > least(109, list_min(list_transform(z, lambda q: q[1][1]))) AND least(109, list_max(list_transform(z, lambda q: q[1][2]))) > least(109, list_min(list_transform(z, lambda q: q[1][2])))
  THEN [CAST(trunc(least(109, list_min(list_transform(z, lambda q: q[1][1])))) AS BIGINT), CAST(trunc(least(109, list_min(list_transform(z, lambda q: q[1][2])))) AS BIGINT), CAST(trunc(least(109, list_max(list_transform(z, lambda q: q[1][1])))) AS BIGINT), CAST(trunc(least(109, list_max(list_transform(z, lambda q: q[1][2])))) AS BIGINT)] END AS draw_box FROM k WHERE vec_id % 6 <> 5)
SELECT vec_id AS det_id, draw_box, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS draw_idx FROM b WHERE draw_box IS NOT NULL""")
def q_drawable(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("det_id")
    box = {n: F.when(k % 2 == 0, F.lit(float(v))) for n, v in zip(D.BOX, (20, 30, 40, 60), strict=True)}
    rows = _frames(spark, d).withColumns(box | {"kp_conf": F.when(k % 6 != 5, F.transform("kp_conf", lambda c: F.when(c >= 0.4, c).otherwise(F.lit(0.0)))).otherwise(F.transform("kp_conf", lambda c: c * 0))})
    return D.drawable(rows, F.lit(110), F.lit(110)).select("det_id", "draw_box", "draw_idx")
