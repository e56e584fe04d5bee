"""Further queries: vector, box and naming functions, lifetimes, group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import vectors as V
from trailmark.operators import identity, matches
from trailmark.plans.catalogue import EDGES, OBS, obs, query, table

_NORM = "sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])))"


#: A small negative value rounds to the one zero that has no sign, as in the query.
@query(f"SELECT vec_id, list_transform(embedding, lambda x: round(x::double / {_NORM.format('embedding')}, 6) + 0::DOUBLE) AS v FROM embeddings")
def q_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double / {_NORM.format('embedding')}) AS body, list_slice(embedding, 1, 32) AS part FROM embeddings),
w AS (SELECT vec_id, list_concat(body, CASE WHEN label % 2 = 0 THEN list_transform(part, lambda x: 0.25 * x::double / {_NORM.format('part')}) ELSE list_transform(range(32), lambda x: 0::double) END) AS v, label FROM u)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x::double / {_NORM.format('v')})), 6) AS total, round(CASE WHEN label % 2 = 0 THEN 1 ELSE 1 / 1.25 END, 6) AS coverage FROM w""")
def q_fused_vector(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    part = F.when(F.col("label") % 2 == 0, F.slice("embedding", 1, 32))
    fused, coverage = V.fuse([(F.col("embedding"), 1.0, 64), (part, 0.25, 32)])
    return e.select("vec_id", F.round(F.aggregate(fused, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(coverage, 6).alias("coverage"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(list_slice(a.embedding, 1, 32) AS DOUBLE[]), CAST(list_slice(b.embedding, 1, 32) AS DOUBLE[])), 6) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_masked_cosine(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "embeddings").alias("a"), table(spark, d, "embeddings").alias("b")
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i <= 32)
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), F.round(V.masked_cosine(F.col("a.embedding"), F.col("b.embedding"), mask), 6).alias("sim"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 AND d <= 0.55 THEN 'near' WHEN user_id % 2 = 0 AND d <= 0.85 THEN 'mid' WHEN user_id % 2 = 0 AND d <= 1.2 THEN 'far' ELSE 'default' END AS zone, CASE WHEN user_id % 2 = 0 AND d <= 0.55 THEN 0.003 WHEN user_id % 2 = 0 AND d <= 0.85 THEN 0.005 WHEN user_id % 2 = 0 AND d <= 1.2 THEN 0.007 ELSE 0.008 END::double AS threshold FROM (SELECT *, value / 50 AS d FROM events)")
def q_overlap_zone(spark: SparkSession, d: str) -> DataFrame:
    value, reason = V.overlap_zone(F.col("value") / 50, F.col("user_id") % 2 == 0)
    return table(spark, d, "events").select("event_id", reason.alias("zone"), value.alias("threshold"))


@query(OBS + "SELECT DISTINCT epoch_id, local_track_id, 'E' || epoch_id || ':T' || local_track_id AS node FROM obs")
def q_node_names(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).select("epoch_id", "local_track_id").distinct().withColumn("node", V.node_name(F.col("epoch_id"), F.col("local_track_id")))


@query("SELECT event_id, greatest(0, least(99, trunc(value - 20)))::int AS x1, greatest(0, least(99, trunc(value + 30)))::int AS x2 FROM events WHERE greatest(0, least(99, trunc(value + 30))) > greatest(0, least(99, trunc(value - 20)))")
def q_clip_box(spark: SparkSession, d: str) -> DataFrame:
    box = V.clip_box(F.col("value") - 20, F.lit(0.0), F.col("value") + 30, F.lit(50.0), 100, 100)
    return table(spark, d, "events").select("event_id", box.alias("b")).where("b is not null").select("event_id", F.col("b")[0].alias("x1"), F.col("b")[2].alias("x2"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def q_name_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("bigint").alias("number"))


@query(OBS + ", t AS (SELECT DISTINCT global_track_id, frame_idx FROM obs WHERE global_track_id IS NOT NULL), s AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w <= 10 THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY global_track_id ORDER BY frame_idx)), l AS (SELECT *, sum(starts) OVER (PARTITION BY global_track_id ORDER BY frame_idx) AS life FROM s) SELECT global_track_id, CAST(life AS BIGINT) AS life, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_frames FROM l GROUP BY ALL")
def q_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    """Lives of an identity: a gap of more than ten frames ends one."""
    return matches.lifetimes(obs(spark, d))


@query(OBS + "SELECT global_track_id, frame_idx, arg_max(event_id, event_id) AS event_id FROM obs WHERE global_track_id IS NOT NULL GROUP BY ALL")
def q_last_row_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return matches.last_per_frame(obs(spark, d), F.col("event_id"))


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events")
def q_lag_compare(spark: SparkSession, d: str) -> DataFrame:
    return matches.change(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "change")


@query(f"SELECT label, round(coalesce(avg(sim), 1), 6) AS mean_sim, round(coalesce(min(sim), 1), 6) AS min_sim FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN (SELECT a.label AS g, e.sim FROM ({EDGES}) e JOIN embeddings a ON a.vec_id = e.i JOIN embeddings b ON b.vec_id = e.j WHERE a.label = b.label) ON g = label GROUP BY ALL")
def q_group_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    g = identity.group_similarity(e, "label", id_col="vec_id", vector="embedding")
    return g.select("label", F.round("mean_sim", 6).alias("mean_sim"), F.round("min_sim", 6).alias("min_sim"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN round(sim, 6) < 0.3 THEN 'below_threshold' WHEN a.label = b.label THEN 'same_epoch' ELSE 'candidate' END AS reason FROM ({EDGES}) e JOIN embeddings a ON a.vec_id = e.i JOIN embeddings b ON b.vec_id = e.j) GROUP BY ALL")
def q_rejection_counts(spark: SparkSession, d: str) -> DataFrame:
    return identity.rejection_counts(table(spark, d, "embeddings"), 0.3, digits=6, id_col="vec_id", epoch_col="label", vector="embedding")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.event_id, a.event_id) AS event_id FROM (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) a FULL JOIN (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) b ON a.user_id = b.user_id")
def q_merge_matches(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one; the later map's entries win."""
    first = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return matches.merged(first("view"), first("signup"), "user_id", "event_id")


@query(OBS + "SELECT event_id, coalesce(global_track_id, 880) AS global_track_id FROM obs")
def q_unknown_identity(spark: SparkSession, d: str) -> DataFrame:
    return matches.known_or(obs(spark, d)).select("event_id", "global_track_id")


@query("SELECT event_type, count(*) AS attempts, CAST(count_if(value > 50) AS BIGINT) AS rejected, arg_min(event_id, (value, event_id)) AS best FROM events GROUP BY ALL")
def q_attempt_summary(spark: SparkSession, d: str) -> DataFrame:
    return matches.attempts(table(spark, d, "events"), "event_type", "value", "event_id", 50)


@query("SELECT user_id AS track, arg_min(event_id, (value, event_id)) AS best_detection, min(value) AS best_cost, round(avg(value), 6) AS mean_cost, count(*) AS n_pairs FROM events GROUP BY ALL")
def q_cost_summary(spark: SparkSession, d: str) -> DataFrame:
    costs = table(spark, d, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("detection"), F.col("value").alias("cost"))
    return matches.cost_summary(costs).withColumn("mean_cost", F.round("mean_cost", 6))


@query("SELECT DISTINCT b.user_id AS member FROM (SELECT event_type, user_id FROM events WHERE value > 60) a JOIN (SELECT event_type, user_id FROM events WHERE value > 60) b USING (event_type) WHERE a.user_id = 7 AND b.user_id <> 7")
def q_same_group(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "events").where("value > 60").groupBy("event_type").agg(F.collect_set("user_id").alias("group"))
    return matches.same_group(groups, 7)


@query(OBS + "SELECT o.event_id, m.global_track_id FROM obs o JOIN (SELECT epoch_id, local_track_id, min(global_track_id) AS global_track_id FROM obs WHERE local_track_id > 1 AND global_track_id IS NOT NULL GROUP BY ALL) m USING (epoch_id, local_track_id)")
def q_identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Identities of rows by track; rows of tracks outside the mapping are dropped."""
    o = obs(spark, d)
    mapping = o.where("local_track_id > 1 and global_track_id is not null").groupBy("epoch_id", "local_track_id").agg(F.min("global_track_id").alias("global_track_id"))
    return matches.global_of(o.drop("global_track_id"), mapping).select("event_id", "global_track_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS local_track_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 = 0")
def q_local_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The local track of each detection that has one."""
    found = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("local_track_id"))
    return matches.local_of(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), found, ("l_orderkey",))




@query("""WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, list_avg(x) AS mx, list_avg(y) AS my, list_dot_product(x, x) / 64 AS xx, list_dot_product(y, y) / 64 AS yy, list_dot_product(x, y) / 64 AS xy FROM p)
SELECT vec_id, round((2 * mx * my + 1e-4) * (2 * (xy - mx * my) + 9e-4) / ((mx * mx + my * my + 1e-4) * (xx - mx * mx + yy - my * my + 9e-4)), 6) AS ssim FROM m""")
def q_global_ssim(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "embeddings").alias("a"), table(spark, d, "embeddings").alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), F.round(V.global_ssim(F.col("a.embedding"), F.col("b.embedding")), 6).alias("ssim"))


@query("""WITH each AS (
  SELECT l_suppkey AS e, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS f, l_linenumber AS t, count(*) AS hits, bool_or(l_returnflag <> 'R') AS matched
  FROM lineitem GROUP BY ALL),
frames AS (SELECT e, f, lead(f) OVER (PARTITION BY e ORDER BY f) AS nxt FROM (SELECT DISTINCT e, f FROM each)),
due AS (
  SELECT r.e, frames.nxt AS f, r.t
  FROM (SELECT *, row_number() OVER (PARTITION BY e, f ORDER BY hits DESC, t) AS k FROM each) r JOIN frames USING (e, f)
  WHERE k <= 4 AND nxt IS NOT NULL),
missed AS (SELECT DISTINCT e, f FROM due WHERE NOT EXISTS (SELECT 1 FROM each WHERE each.e = due.e AND each.f = due.f AND each.t = due.t AND matched)),
marked AS (SELECT e, f, EXISTS (SELECT 1 FROM missed m WHERE m.e = frames.e AND m.f = frames.f) AS m FROM frames),
runs AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY e ORDER BY f) AS run FROM marked),
budgets AS (SELECT e, f, m, CAST(7 + 9 * sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY e, run ORDER BY f) AS BIGINT) AS budget FROM runs)
SELECT e AS epoch_id, f AS frame_idx, m AS missed_top, budget, CAST(coalesce(lag(budget) OVER (PARTITION BY e ORDER BY f), 9) AS BIGINT) AS used FROM budgets""")
def q_candidate_budget(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as epochs, months as frames, line numbers as tracks."""
    line = table(spark, d, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    states = line.groupBy(F.col("l_suppkey").alias("epoch_id"), month.alias("frame_idx"), F.col("l_linenumber").alias("local_track_id"))
    return matches.candidate_budget(states.agg(F.count("*").alias("hits"), F.max(F.col("l_returnflag") != "R").alias("matched")))
