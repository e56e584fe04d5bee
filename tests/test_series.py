import numpy as np
from pyspark.sql import functions as F

from trailmark.functions import pose
from trailmark.operators import scan
from trailmark.operators.tracking import pose_similarity


def filtered(values, dt=1 / 30, process=1e7, measure=5000.0, p0=1000.0):
    x, v, a, b, c = values[0], 0.0, p0, 0.0, p0
    out = [(x, v, a, b, c)]
    for z in values[1:]:
        x, a, b, c = x + dt * v, a + 2 * dt * b + dt * dt * c + process * dt**4 / 4, b + dt * c + process * dt**3 / 2, c + process * dt * dt
        s, r = a + measure, z - x
        x, v, a, b, c = x + a / s * r, v + b / s * r, a * measure / s, b * measure / s, c - b * b / s
        out.append((x, v, a, b, c))
    return out


def test_scan_equals_the_fold(spark):
    """Series shorter and longer than a block, over one level of blocks and over three."""
    rows = [(k % 3 if k < 3000 else 7, k, float((k * 37) % 101)) for k in range(3500)] + [(8, 1, 5.0), (8, 2, None), (8, 3, 7.0), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "s long, k long, v double").repartition(5)
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    for block, fan in ((4096, 4096), (50, 4)):
        moved = {(r["s"], r["k"]): tuple(r[n] for n in "xvabc") for r in scan.states(df, ["s"], ["k"], "v", scan.kalman_chain(), block, fan).collect()}
        mean = {(r["s"], r["k"]): r["g"] for r in scan.states(df.withColumn("v", F.col("v") / 100), ["s"], ["k"], "v", scan.ema_chain(0.3), block, fan).collect()}
        assert set(moved) == set(mean) == {r[:2] for r in known}
        for s in {r[0] for r in known}:
            own, g = [r for r in known if r[0] == s], 1.0
            for r, want in zip(own, filtered([r[2] for r in own]), strict=True):
                g = 0.7 * g + 0.3 * min(1.0, max(0.0, r[2] / 100))
                assert np.allclose(moved[s, r[1]], want, rtol=1e-9, atol=1e-9) and abs(mean[s, r[1]] - g) < 1e-12
    assert scan.states(df.limit(0), ["s"], ["k"], "v", scan.ema_chain(0.3)).count() == 0


def test_a_series_is_spread_over_tasks(spark):
    df = spark.range(60_000).select(F.lit("one").alias("s"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be one range
    try:
        blocks = scan._blocks(df.select("s", "k", F.col("v").alias("value")), ["s"], ["k"], 1000)
        parts, most = blocks.agg(F.count_distinct("part"), F.max("n")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1 and most <= 1000
    assert scan.states(df, ["s"], ["k"], "v", scan.ema_chain(0.1), 1000, 8).count() == 60_000


def test_pose_similarity_of_random_poses(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(300):
        a = rng.normal(size=(25, 2)) * 50
        b = a + rng.normal(size=(25, 2)) * rng.choice([1, 20, 80]) if rng.random() < 0.6 else rng.normal(size=(25, 2)) * 50
        for x in (a, b):
            if rng.random() < 0.2:
                x[rng.integers(25)] = np.nan
        if rng.random() < 0.3:
            for i, j in pose.SWAPS:
                b[[i, j]] = b[[j, i]]
        conf = [None if rng.random() < 0.2 else rng.choice([0.01, 0.9], size=25, p=[q, 1 - q]) for q in (0.4, 0.2)]
        a = a[:20] if k % 40 == 0 else a
        want[k] = pose_similarity(a, conf[0], b, conf[1], 0.05)
        rows.append((k, a.tolist(), None if conf[0] is None else conf[0].tolist(), b.tolist(), None if conf[1] is None else conf[1].tolist()))
    rows.append((300, None, None, rows[1][3], None))
    want[300] = 0.0
    df = spark.createDataFrame(rows, "k long, a array<array<double>>, ca array<double>, b array<array<double>>, cb array<double>")
    got = {r["k"]: r["v"] for r in df.select("k", pose.pose_similarity(F.col("a"), F.col("ca"), F.col("b"), F.col("cb")).alias("v")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and sum(v > 0 for v in want.values()) > 100
