"""The query catalogue over the provided tables, with the SQL each must agree with.

The episode model is read into the tables thus: ``events`` are readings (episode ``user_id``, stream ``event_type``,
time ``ts`` in microseconds), ``embeddings`` joint vectors (episode ``label``, frame order ``vec_id``),
``conversations`` frames in order (episode ``conv_id``, frame ``turn``), ``orders`` episodes, ``part`` tasks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import align, episodes, frames, repair, smooth, stats
from ..sinks import episodic, packed
from ..sinks.common import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries that no SQL expresses.
ROWS_ONLY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The grid of the alignment queries, in microseconds.
STEP = 6 * 3600 * 1_000_000
WIDTH = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_JOINTS = [*(f"joint{k}" for k in range(1, WIDTH)), "gripper"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").alias("episode"), F.col("event_type").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value", "event_id")


_R = "r AS (SELECT user_id AS episode, event_type AS stream, epoch_us(ts) AS t, value, event_id FROM events)"
_RANGE = f"""{_R}, ends AS (SELECT episode, stream, min(t) AS f, max(t) AS l FROM r GROUP BY ALL),
g AS (SELECT episode, max(f) AS start, min(l) AS stop FROM ends GROUP BY episode),
n AS (SELECT *, CAST(greatest(0, ceil((stop - start) / {STEP}.0)) AS BIGINT) AS n FROM g),
grid AS (SELECT episode, start, stop, unnest(range(n)) AS k FROM n),
pts AS (SELECT episode, k, start + k * {STEP} AS grid_t FROM grid)"""
_STATS = """min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS q01,
round(quantile_cont(x, 0.1), 6) AS q10, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.9), 6) AS q90, round(quantile_cont(x, 0.99), 6) AS q99, count(*) AS count"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double" and c not in ("min", "max")})


# sources and scans


@query("SELECT DISTINCT user_id AS episode, event_type AS stream, 'ep' || user_id || '/obs/' || event_type AS entity FROM events")
def stream_catalog(spark, sf):
    return frames.stream_entities(readings(spark, sf), "episode", "stream", "obs")


@query("SELECT event_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'click'")
def load_obs_filter(spark, sf):
    return frames.only(readings(spark, sf), "stream", "click").select("event_id", "t", "value")


@query("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS {n}" for i, n in enumerate(_JOINTS)) + " FROM embeddings")
def joint_projection(spark, sf):
    return frames.named_joints(_t(spark, sf, "embeddings"), "embedding", _JOINTS, "vec_id")


@query("SELECT event_id, CAST(epoch_us(ts) * 1000 AS DOUBLE) / 1e9 AS unix_time FROM events")
def unixtime(spark, sf):
    return readings(spark, sf).select("event_id", X.unix_seconds(F.col("t") * 1000).alias("unix_time"))


@query("SELECT event_type AS camera, count(*) AS frames FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def camera_projection(spark, sf):
    return frames.only(readings(spark, sf), "stream", "view", "click").groupBy(F.col("stream").alias("camera")).agg(F.count("*").alias("frames"))


@query("SELECT lang AS dataset, count(DISTINCT source) AS formats, count(DISTINCT source) = 1 AS uniform FROM documents GROUP BY lang")
def camera_format_check(spark, sf):
    return frames.uniform_formats(_t(spark, sf, "documents").withColumnRenamed("lang", "dataset"), "source", "dataset")


@query(r"""SELECT page_id, TRY_CAST(nullif(regexp_extract(url || '/' || (page_id * 1000003) || '.jpeg', '([0-9]+)\.[^./]*$', 1), '') AS BIGINT) AS t_ns FROM pages""")
def frame_timestamp_parse(spark, sf):
    p = _t(spark, sf, "pages")
    path = F.concat("url", F.lit("/"), (F.col("page_id") * 1000003).cast("string"), F.lit(".jpeg"))
    return p.select("page_id", X.frame_time_ns(path).alias("t_ns"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) WHERE i = 2")
def frame_by_index(spark, sf):
    return frames.frame_at(_t(spark, sf, "conversations"), 2, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role")


@query("SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def first_frame(spark, sf):
    return frames.first_of(_t(spark, sf, "conversations"), ["conv_id"], "turn", first_role="role")


@query("SELECT conv_id, count(*) AS num_frames, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id")
def frame_sizes(spark, sf):
    return frames.frame_totals(_t(spark, sf, "conversations"), ["conv_id"], F.octet_length("text"))


def _returned(spark, sf):
    return _t(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))


# alignment


@query(f"WITH {_RANGE} SELECT episode, start, stop AS \"end\" FROM g")
def common_range(spark, sf):
    return align.common_range(readings(spark, sf), "episode", "stream", "t")


@query(f"WITH {_RANGE} SELECT episode, k, grid_t AS t FROM pts")
def time_grid(spark, sf):
    g = align.with_grid(align.common_range(readings(spark, sf), "episode", "stream", "t"), STEP)
    return align.time_grid(g, "episode")


_ASOF = f"""WITH {_RANGE}, st AS (SELECT DISTINCT episode, stream FROM r), want AS (SELECT p.episode, s.stream, k, grid_t FROM pts p JOIN st s ON p.episode = s.episode),
a AS (SELECT w.episode, w.stream, w.k, w.grid_t, r.t, r.value, r.event_id FROM want w ASOF JOIN r ON w.episode = r.episode AND w.stream = r.stream AND w.grid_t <= r.t)"""


def _aligned(spark, sf):
    r = readings(spark, sf)
    g = align.with_grid(align.common_range(r, "episode", "stream", "t"), STEP)
    return align.forward_asof(r, g, "episode", "stream", "t", ["event_id"])


@query(_ASOF + " SELECT episode, stream, k, grid_t, t, value, event_id FROM a")
def sample_forward_asof(spark, sf):
    return _aligned(spark, sf)


_STREAMS = ["click", "error", "purchase", "signup", "view"]


@query(_ASOF + " SELECT episode, k, grid_t, " + ", ".join(f"max(value) FILTER (stream = '{s}') AS {s}" for s in _STREAMS) + " FROM a GROUP BY episode, k, grid_t")
def sample_aligned_wide(spark, sf):
    return align.assembled_wide(_aligned(spark, sf), "episode", "stream", "value", _STREAMS)


@query(_ASOF + " SELECT episode, k, grid_t, string_agg(stream, ',' ORDER BY stream) AS keys, round(sum(value), 6) AS total, count(*) AS streams FROM a GROUP BY episode, k, grid_t")
def sample_aligned_map(spark, sf):
    m = align.assembled(_aligned(spark, sf), "episode", "stream", "value")
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda s, x: s + x)
    return m.select("episode", "k", "grid_t", F.array_join(F.array_sort(F.map_keys("values")), ",").alias("keys"), F.round(total, 6).alias("total"), F.size("values").cast("bigint").alias("streams"))


@query(f"""WITH e AS (SELECT vec_id, list_concat(embedding[33:{WIDTH}], embedding[1:32]) AS v FROM embeddings)
SELECT vec_id, CAST(len(v) AS INTEGER) AS width, v[1] AS first, v[{WIDTH}] AS last, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM e""")
def vector_concat_f32(spark, sf):
    v = X.concat_float32(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
    total = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _t(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("width"), F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(WIDTH - 1)).alias("last"), F.round(total, 5).alias("total"))


# features and indices


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def success_only(spark, sf):
    return frames.successful(_t(spark, sf, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS episode_index FROM orders WHERE o_orderstatus = 'F'")
def episode_remap(spark, sf):
    kept = frames.successful(_t(spark, sf, "orders"), F.col("o_orderstatus") == "F")
    return episodes.episode_remap(kept.select("o_orderkey"), "o_orderkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS new_task_index FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def task_remap(spark, sf):
    lines = _t(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    return episodes.task_remap(frames.with_some(_t(spark, sf, "part"), lines, ["p_partkey"]), "p_partkey")


@query("""WITH n AS (SELECT user_id, count(*) AS length FROM events GROUP BY user_id)
SELECT user_id, length, CAST(sum(length) OVER w - length AS BIGINT) AS dataset_from_index, CAST(sum(length) OVER w AS BIGINT) AS dataset_to_index FROM n WINDOW w AS (ORDER BY user_id)""")
def global_frame_index(spark, sf):
    n = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("length"))
    return episodes.global_index(n, "user_id", "length")


@query("SELECT conv_id, turn, turn / 30.0::DOUBLE AS \"timestamp\", count(*) OVER (PARTITION BY conv_id) - 1 AS last_frame_index FROM conversations")
def frame_columns(spark, sf):
    return episodes.frame_columns(_t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 30)


@query("SELECT o_orderkey, format('chunk-{:03d}', o_orderkey // 1000) AS chunk FROM orders")
def chunk_name(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", X.chunk_name("o_orderkey").alias("chunk"))


@query("SELECT DISTINCT 'observation.images.' || p_brand AS feature FROM part")
def feature_name(spark, sf):
    return _t(spark, sf, "part").select(X.image_feature("p_brand").alias("feature")).distinct()


@query("SELECT s_suppkey, 'right_joint' || s_suppkey || '.pos' AS arm, 'elevation.pos' AS lifter FROM supplier")
def joint_names(spark, sf):
    j = F.concat(F.lit("joint"), F.col("s_suppkey").cast("string"))
    return _t(spark, sf, "supplier").select("s_suppkey", X.joint_label(F.lit("right"), j).alias("arm"), X.joint_label(None, F.lit("elevation")).alias("lifter"))


@query("SELECT o_orderkey, c_name AS prompt FROM orders JOIN customer ON o_custkey = c_custkey")
def episode_task_join(spark, sf):
    out = frames.with_task(_t(spark, sf, "orders"), _t(spark, sf, "customer"), "o_custkey", "c_custkey", F.col("c_name").alias("prompt"))
    return out.select("o_orderkey", "prompt")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def stream_exists_semijoin(spark, sf):
    return frames.with_some(_t(spark, sf, "orders").select("o_orderkey"), _returned(spark, sf), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_antijoin(spark, sf):
    return frames.without_any(_t(spark, sf, "orders").select("o_orderkey"), _returned(spark, sf), ["o_orderkey"])


@query("""WITH d AS (SELECT l_orderkey, count(*) AS data_frames FROM lineitem GROUP BY l_orderkey), v AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey)
SELECT d.l_orderkey, data_frames, coalesce(n, 0) AS video_frames, data_frames = coalesce(n, 0) AS consistent FROM d LEFT JOIN v ON d.l_orderkey = v.l_orderkey""")
def frame_count_guard(spark, sf):
    lines = _t(spark, sf, "lineitem")
    data = lines.groupBy("l_orderkey").agg(F.count("*").alias("data_frames"))
    video = frames.only(lines, "l_linestatus", "O").groupBy("l_orderkey").agg(F.count("*").alias("video_frames"))
    return frames.frame_guard(data, video, ["l_orderkey"])


# statistics


@query(f"""WITH x AS (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, {_STATS} FROM x GROUP BY label, pos""")
def describe_vector(spark, sf):
    return _rounded(stats.describe_vector(_t(spark, sf, "embeddings"), "embedding", "label"))


@query(f"WITH x AS (SELECT user_id, value AS x FROM events) SELECT user_id, {_STATS} FROM x GROUP BY user_id")
def describe_scalar(spark, sf):
    return _rounded(stats.describe(_t(spark, sf, "events"), "value", "user_id"))


@query(f"WITH x AS (SELECT value AS x FROM events) SELECT {_STATS} FROM x")
def describe_overall(spark, sf):
    return _rounded(stats.describe(_t(spark, sf, "events"), "value"))


@query(f"WITH x AS (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS x FROM events) SELECT event_type, {_STATS} FROM x GROUP BY event_type")
def describe_with_nan(spark, sf):
    e = _t(spark, sf, "events")
    return _rounded(stats.describe(e.withColumn("x", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))), "x", "event_type"))


@query("""WITH e AS (SELECT event_type, user_id, min(value) AS mn, max(value) AS mx, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n,
quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.1) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.9) AS d, quantile_cont(value, 0.99) AS f FROM events GROUP BY ALL),
t AS (SELECT event_type, sum(m * n) / sum(n) AS mu FROM e GROUP BY event_type)
SELECT e.event_type, min(mn) AS min, max(mx) AS max, round(any_value(mu), 6) AS mean, round(sqrt(sum(n * (s * s + (m - mu) * (m - mu))) / sum(n)), 6) AS std,
round(sum(a * n) / sum(n), 6) AS q01, round(sum(b * n) / sum(n), 6) AS q10, round(sum(c * n) / sum(n), 6) AS q50, round(sum(d * n) / sum(n), 6) AS q90, round(sum(f * n) / sum(n), 6) AS q99,
CAST(sum(n) AS BIGINT) AS count FROM e JOIN t ON e.event_type = t.event_type GROUP BY e.event_type""")
def pooled_stats(spark, sf):
    return _rounded(stats.pooled(stats.describe(_t(spark, sf, "events"), "value", "event_type", "user_id"), "event_type"))


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user ' || user_id, count(*) FROM events GROUP BY user_id)
SELECT event_type, n, CASE WHEN n < 100 THEN n ELSE CAST(greatest(100, least(floor(pow(n, 0.75)), 10000)) AS BIGINT) END AS k FROM n""")
def image_sample_size(spark, sf):
    e = _t(spark, sf, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n")).unionByName(e.groupBy(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("event_type")).agg(F.count("*").alias("n")))
    return n.withColumn("k", X.image_sample_size("n"))


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
s AS (SELECT *, CASE WHEN n < 100 THEN n ELSE CAST(greatest(100, least(floor(pow(n, 0.75)), 10000)) AS BIGINT) END AS k FROM n),
i AS (SELECT *, unnest(range(k)) AS i FROM s)
SELECT event_type, i, CAST(round_even(i * (CAST(n - 1 AS DOUBLE) / greatest(k - 1, 1)), 0) AS BIGINT) AS frame FROM i""")
def even_indices(spark, sf):
    n = _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("k", X.image_sample_size("n"))
    i = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    return i.select("event_type", "i", X.even_index("i", "n", "k").alias("frame"))


@query("""WITH p AS (SELECT label, CAST(floor(abs(unnest(embedding)) * 255) AS BIGINT) AS x FROM embeddings),
m AS (SELECT label, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS mean, CAST(sum(x * x) AS DOUBLE) / count(*) AS sq, min(x) AS lo, max(x) AS hi FROM p GROUP BY label)
SELECT label, n, round(lo / 255.0, 6) AS min, round(hi / 255.0, 6) AS max, round(mean / 255.0, 6) AS mean, round(sqrt(greatest(sq - mean * mean, 0)) / 255.0, 6) AS std FROM m""")
def pixel_moments(spark, sf):
    e = _t(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v"))
    x = F.floor(F.abs("v").cast("float") * 255).cast("bigint")
    parts = e.select("label", x.alias("x")).groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))
    out = stats.image_moments(parts, "label")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


@query("""SELECT count(*) AS total_frames, count(DISTINCT l_orderkey) AS total_episodes, count(DISTINCT l_suppkey) AS total_tasks,
count(DISTINCT l_orderkey) * 4 AS total_videos, CAST(ceil(count(DISTINCT l_orderkey) / 1000.0) AS BIGINT) AS total_chunks FROM lineitem""")
def dataset_totals(spark, sf):
    return frames.totals(_t(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 4)


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), e AS (SELECT *, CAST(round_even(n * CAST(0.85 AS DOUBLE), 0) AS BIGINT) AS te FROM n)
SELECT user_id, '0:' || te AS train, CASE WHEN te < n THEN te || ':' || n END AS val FROM e""")
def train_val_split(spark, sf):
    n = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return frames.split_ranges(n, "n", 0.85).select("user_id", "train", "val")


# data quality

_GAP = "CASE WHEN event_id % 37 = 0 OR event_id % 97 < 2 THEN NULL ELSE value END"


def _gappy(spark, sf):
    gap = (F.col("event_id") % 37 == 0) | (F.col("event_id") % 97 < 2)
    return readings(spark, sf).withColumn("x", F.when(gap & (F.col("event_id") % 2 == 0), F.lit(float("nan"))).when(~gap, F.col("value")))


def _holed(spark, sf):
    """Vectors with a missing element, a NaN element, none at all, or whole."""
    e = _t(spark, sf, "embeddings")
    i = F.col("vec_id")
    v = F.transform("embedding", lambda x, p: F.when((i % 13 == 5) & (p == i % WIDTH), F.lit(None).cast("float")).when((i % 17 == 3) & (p == (i * 7) % WIDTH), F.lit(float("nan")).cast("float")).otherwise(x))
    return e.select("vec_id", "label", F.when(i % 29 != 11, v).alias("v"))


_HOLED = f"""h AS (SELECT vec_id, label, CASE WHEN vec_id % 29 <> 11 THEN list_transform(embedding, lambda x, p:
CASE WHEN vec_id % 13 = 5 AND p - 1 = vec_id % {WIDTH} THEN NULL WHEN vec_id % 17 = 3 AND p - 1 = (vec_id * 7) % {WIDTH} THEN NULL ELSE x END) END AS v FROM embeddings)"""


@query(f"""WITH {_HOLED}, b AS (SELECT label, v IS NULL OR len(list_filter(v, lambda x: x IS NULL)) > 0 AS bad FROM h)
SELECT label, count(*) AS rows, CAST(sum(bad::INT) AS BIGINT) AS bad_rows, NOT bool_or(bad) AS valid FROM b GROUP BY label""")
def validate_nulls(spark, sf):
    return repair.gap_counts(_holed(spark, sf), "v", "label")


_REPAIR = f"""WITH x AS (SELECT event_id, user_id, event_type, ts, {_GAP} AS x FROM events),
n AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM x WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
f AS (SELECT event_id, user_id AS episode, event_type AS stream, x IS NULL AS gap, coalesce(x, (p + q) / 2) AS repaired FROM n)"""


@query(_REPAIR + " SELECT event_id, repaired, CASE WHEN NOT gap THEN 'ok' WHEN repaired IS NOT NULL THEN 'repaired' ELSE 'unrepairable' END AS status FROM f")
def repair_gaps(spark, sf):
    return repair.repair_values(_gappy(spark, sf), "x", ["episode", "stream"], ["t", "event_id"]).select("event_id", "repaired", "status")


@query(_REPAIR + " SELECT episode, stream, CAST(sum((gap AND repaired IS NOT NULL)::INT) AS BIGINT) AS n_repaired, CAST(sum((gap AND repaired IS NULL)::INT) AS BIGINT) AS n_unrepairable FROM f GROUP BY episode, stream")
def repair_report(spark, sf):
    return repair.repair_report(repair.repair_values(_gappy(spark, sf), "x", ["episode", "stream"], ["t", "event_id"]), "episode", "stream")


@query(f"""WITH {_HOLED}, f AS (SELECT vec_id, label, coalesce(v, list_transform(range({WIDTH}), lambda i: CAST(NULL AS FLOAT))) AS v, v IS NULL AS whole FROM h),
n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM f WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
l AS (SELECT vec_id, unnest(range(1, {WIDTH + 1})) AS i, v, p, q FROM n),
r AS (SELECT vec_id, v[i] IS NULL AS gap, coalesce(CAST(v[i] AS DOUBLE), CAST((CAST(p[i] AS DOUBLE) + CAST(q[i] AS DOUBLE)) / 2 AS FLOAT)) AS x FROM l)
SELECT vec_id, CAST(sum(gap::INT) AS INTEGER) AS n_missing, CAST(sum((x IS NULL)::INT) AS INTEGER) AS n_left, round(coalesce(sum(x), 0), 5) AS total FROM r GROUP BY vec_id""")
def repair_vector_gaps(spark, sf):
    r = repair.repair_vectors(_holed(spark, sf), "v", ["label"], ["vec_id"], WIDTH)
    total = F.aggregate(F.transform("repaired", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return r.select("vec_id", "n_missing", "n_left", F.round(total, 5).alias("total"))


# merging


@query("""WITH u AS (SELECT 0 AS d, s_suppkey AS p, s_acctbal > 0 AS success FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal > 0 FROM customer)
SELECT CAST(d AS INTEGER) AS dataset_pos, p AS episode_pos, success, CAST(row_number() OVER (ORDER BY d, p) - 1 AS VARCHAR) AS id FROM u""")
def merge_union_renumber(spark, sf):
    s = _t(spark, sf, "supplier").select(F.lit(0).alias("dataset_pos"), F.col("s_suppkey").alias("episode_pos"), (F.col("s_acctbal") > 0).alias("success"), F.lit(0).alias("task_index"))
    c = _t(spark, sf, "customer").select(F.lit(1).alias("dataset_pos"), F.col("c_custkey").alias("episode_pos"), (F.col("c_acctbal") > 0).alias("success"), F.lit(0).alias("task_index"))
    one = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "dataset_pos int, task_index int, new_task_index bigint")
    return episodes.merged_episodes(s.unionByName(c), one).select("dataset_pos", "episode_pos", "success", "id")


def _tasks(spark, sf):
    p = _t(spark, sf, "part")
    return p.select((F.col("p_size") % 3).cast("int").alias("dataset_pos"), F.col("p_partkey").alias("task_index"), F.col("p_type").alias("prompt"), F.col("p_name").alias("description"))


_MERGE = """WITH t AS (SELECT p_size % 3 AS d, p_partkey AS i, p_type AS prompt, p_name AS description FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY d, i) AS rn FROM t),
m AS (SELECT prompt, description, row_number() OVER (ORDER BY d, i) - 1 AS new_task_index FROM f WHERE rn = 1)"""


@query(_MERGE + " SELECT new_task_index, prompt, description FROM m")
def merge_task_dedup(spark, sf):
    return episodes.merged_tasks(_tasks(spark, sf))[0]


@query(_MERGE + " SELECT CAST(d AS INTEGER) AS dataset_pos, i AS task_index, new_task_index FROM t JOIN m ON t.prompt = m.prompt")
def merge_task_map(spark, sf):
    return episodes.merged_tasks(_tasks(spark, sf))[1]


@query("""SELECT n.n_nationkey AS dataset, n.n_regionkey IS DISTINCT FROM z.n_regionkey AS mismatch FROM nation n, (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) z WHERE n.n_nationkey > 0""")
def merge_compat(spark, sf):
    n = _t(spark, sf, "nation")
    out = frames.mismatches(n.where("n_nationkey > 0"), n.where("n_nationkey = 0"), "n_regionkey")
    return out.select(F.col("n_nationkey").alias("dataset"), "mismatch")


# packing and sinks


@query("""WITH RECURSIVE d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS s, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
f AS (SELECT i, doc_id, s AS held, CAST(0 AS BIGINT) AS file FROM d WHERE i = 1
      UNION ALL SELECT d.i, d.doc_id, CASE WHEN f.held + d.s >= 50000 THEN d.s ELSE f.held + d.s END, f.file + CASE WHEN f.held + d.s >= 50000 THEN 1 ELSE 0 END FROM f JOIN d ON d.i = f.i + 1)
SELECT doc_id, file AS file_seq, file // 1000 AS chunk_index, file % 1000 AS file_index FROM f""")
def pack_files(spark, sf):
    return episodes.packed_files(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50_000)


@query("""WITH n AS (SELECT conv_id, count(*) AS n, conv_id // 10 AS file FROM conversations GROUP BY conv_id)
SELECT conv_id, (sum(n) OVER w - n) / 30.0::DOUBLE AS from_timestamp, sum(n) OVER w / 30.0::DOUBLE AS to_timestamp FROM n WINDOW w AS (PARTITION BY file ORDER BY conv_id)""")
def video_timestamps(spark, sf):
    n = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return frames.video_times(n, [F.floor(F.col("conv_id") / 10)], "conv_id", "n", 30).select("conv_id", "from_timestamp", "to_timestamp")


@query("SELECT 'ep' || label || '/obs/joint' || (unnest(range(len(embedding))) + 1) AS entity, vec_id AS \"timestamp\", CAST(unnest(embedding) AS DOUBLE) AS scalar FROM embeddings")
def long_series(spark, sf):
    joint = F.concat(F.lit("joint"), (F.col("pos") + 1).cast("string"))
    return frames.long_series(_t(spark, sf, "embeddings"), "embedding", X.entity_path("label", F.lit("obs"), joint), "vec_id")


@query("""WITH w AS (SELECT n_nationkey, n_name, CAST(n_nationkey % 3 + 1 AS BIGINT) AS width FROM nation)
SELECT n_name AS key, CAST(sum(width) OVER o - width AS BIGINT) AS start, CAST(sum(width) OVER o AS BIGINT) AS "end" FROM w WINDOW o AS (ORDER BY n_nationkey)""")
def gr00t_ranges(spark, sf):
    n = _t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("key"), (F.col("n_nationkey") % 3 + 1).cast("bigint").alias("width"))
    out = episodes.global_index(n, "n_nationkey", "width")
    return out.select("key", F.col("dataset_from_index").alias("start"), F.col("dataset_to_index").alias("end"))


@query("""SELECT p_partkey AS value, CASE p_partkey % 4 WHEN 0 THEN 'wrist_left' WHEN 1 THEN 'wrist_right' WHEN 2 THEN 'ceiling' ELSE 'head' END AS camera FROM part""")
def schema_upgrade(spark, sf):
    old = F.element_at(F.array(*map(F.lit, ("left_wrist", "right_wrist", "ceiling", "head"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("positions"), old.alias("old"))
    return p.withColumnRenamed("positions", "value").select("value", X.camera_name("old").alias("camera"))


@query("""WITH e AS (SELECT o_orderkey AS e, o_orderstatus = 'F' AS s FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT l_orderkey AS e, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k FROM lineitem),
i AS (SELECT e, s, row_number() OVER (ORDER BY e) - 1 AS ei FROM (SELECT e.e, e.s FROM e WHERE e.e IN (SELECT e FROM f))),
n AS (SELECT e, count(*) AS n FROM f GROUP BY e), g AS (SELECT i.*, n.n, sum(n.n) OVER (ORDER BY ei) - n.n AS base FROM i JOIN n ON i.e = n.e)
SELECT ei AS episode_index, k AS frame_index, CAST(base + k AS BIGINT) AS index, k / 30.0::DOUBLE AS "timestamp", CAST(s AS BIGINT) AS success, n - 1 AS last_frame_index FROM g JOIN f ON f.e = g.e""")
def export_features(spark, sf):
    """The frame table of an export: dense episodes, frames within and over episodes, success and length."""
    kept = _t(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("e"), (F.col("o_orderstatus") == "F").alias("s"))
    lines = _t(spark, sf, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    numbered = lines.select(F.col("l_orderkey").alias("e"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"))
    lengths = numbered.groupBy("e").agg(F.count("*").alias("n"))
    table = episodes.global_index(episodes.episode_remap(kept.join(lengths, "e"), "e"), "episode_index", "n")
    out = numbered.join(table, "e")
    return out.select("episode_index", "frame_index", (F.col("dataset_from_index") + F.col("frame_index")).alias("index"), (F.col("frame_index") / 30.0).alias("timestamp"), F.col("s").cast("bigint").alias("success"), (F.col("n") - 1).alias("last_frame_index"))


# files


def _recording(spark, sf):
    """The frame table of an export of joint vectors: an episode a label, its frames in the order of their ids."""
    e = _t(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("label"), "vec_id", "embedding")
    f = e.withColumn("frame_index", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint"))
    lengths = f.groupBy("label").agg(F.count("*").alias("n"))
    table = episodes.global_index(episodes.episode_remap(lengths, "label"), "episode_index", "n")
    return f.join(table, "label").select(
        F.col("embedding").alias("action"), F.reverse("embedding").alias("observation.state"), (F.col("frame_index") / F.lit(30.0)).alias("timestamp"), "frame_index", "episode_index",
        (F.col("dataset_from_index") + F.col("frame_index")).alias("index"), (F.col("label") % 3).alias("task_index"), (F.col("label") % 2).alias("success"), (F.col("n") - 1).alias("last_frame_index"))


def _folder(spark) -> str:
    """A new path that every executor mounts: below ``spark.checkpoint.dir``, or on one machine a temporary one; gone at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    base = named.removeprefix("file:") if named else None
    if base:
        os.makedirs(base, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="kinetrace-files-", dir=base)
    atexit.register(shutil.rmtree, folder, True)
    return folder


def _read_back(df: DataFrame, *more) -> DataFrame:
    v = lambda c, i: F.element_at(F.col(f"`{c}`"), i)
    return df.select(
        "episode_index", "frame_index", "index", "timestamp", "task_index", "success", "last_frame_index", *more,
        v("action", 1).alias("first"), v("action", -1).alias("last"), v("observation.state", 1).alias("state_first"), F.size("action").alias("width"))


_ROUND = """WITH f AS (SELECT label, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n,
dense_rank() OVER (ORDER BY label) - 1 AS e, row_number() OVER (ORDER BY label, vec_id) - 1 AS i FROM embeddings)
SELECT e AS episode_index, k AS frame_index, i AS index, k / 30.0::DOUBLE AS "timestamp", CAST(label % 3 AS BIGINT) AS task_index, CAST(label % 2 AS BIGINT) AS success, n - 1 AS last_frame_index,
{more}v[1] AS first, v[len(v)] AS last, v[len(v)] AS state_first, CAST(len(v) AS INTEGER) AS width FROM f"""


@query(_ROUND.format(more="format('chunk-{:03d}/episode_{:06d}.parquet', e // 1000, e) AS file, "))
def write_read_roundtrip_v21(spark, sf):
    """A file an episode, written and read again, with the file's name."""
    folder = _folder(spark)
    episodic.write_frames(plain(_recording(spark, sf)), Path(folder))
    return _read_back(spark.read.parquet(f"file://{folder}/data/*/*.parquet"), F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0).alias("file"))


@query(_ROUND.format(more=""))
def write_read_roundtrip_v30(spark, sf):
    """Files of many episodes, of a tenth of a megabyte, written and read again."""
    folder = _folder(spark)
    packed.write_frames(plain(_recording(spark, sf)), Path(folder), 0.1)
    return _read_back(spark.read.parquet(f"file://{folder}/data/*/*.parquet"))


# smoothing


def smooth_series(spark, sf):
    """Every stream of the events, filtered in the order of time and id; a null reading leaves its stream as it is."""
    order = W.partitionBy("episode", "stream").orderBy("t", "event_id")
    r = readings(spark, sf).withColumn("row_pos", F.row_number().over(order).cast("bigint"))
    r = r.withColumn("values", F.when(F.col("value").isNotNull(), F.array(F.col("value").cast("double"))))
    r = smooth.smoothed(r.select("episode", "stream", "t", "event_id", "row_pos", "values"), ["episode", "stream"], 5.0)
    return r.select("episode", "stream", "t", "event_id", F.get("values", F.lit(0)).alias("value"))


ROWS_ONLY["smooth_series"] = smooth_series
