"""Range, interval and temporal joins and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from runnel.functions.columns import long_segments_confidence, many_segments_confidence
from runnel.operators import joins as J
from runnel.operators import segments as S
from runnel.plans.registry import Registry
from runnel.sources.tables import BOUNDARIES, NODES, SERIES, boundaries, nodes, series, table

REGISTRY = Registry()
query = REGISTRY.query
STEP, REACH = 86400.0, 43200.0
GRID = f"""{BOUNDARIES}, ends AS (SELECT recording_id, min(t) AS lo, max(t) AS hi FROM boundaries GROUP BY 1),
 grid AS (SELECT recording_id, (floor(lo / {STEP}) + unnest(range(0, (floor(hi / {STEP}) - floor(lo / {STEP}))::BIGINT + 1))) * {STEP} AS t FROM ends)"""
COUNTS = f"{GRID}, counts AS (SELECT grid.recording_id, grid.t, count(b.t) AS n FROM grid LEFT JOIN boundaries b ON b.recording_id = grid.recording_id AND b.t >= grid.t - {REACH} AND b.t <= grid.t + {REACH} GROUP BY 1, 2)"


def grid(spark, d):
    """A row per day of each recording, from its first to its last boundary."""
    k = F.floor(F.col("t") / STEP)
    ends = boundaries(spark, d).groupBy("recording_id").agg(F.min(k).alias("lo"), F.max(k).alias("hi"))
    return ends.select("recording_id", F.explode(F.sequence("lo", "hi")).alias("k")).select("recording_id", (F.col("k") * STEP).alias("t"))


def _counts(spark, d):
    return J.range_count(grid(spark, d), boundaries(spark, d).select("recording_id", "t"), REACH)


@query(f"WITH {COUNTS} SELECT * FROM counts")
def j1_a7_range_count(spark, d):
    return _counts(spark, d)


@query(f"WITH {COUNTS} SELECT recording_id, t, CASE WHEN n < 4 THEN -(n - 2) / 2.0 ELSE -1.0 END AS confidence, n <= 1 AS flag FROM counts")
def p6_many_segments_confidence(spark, d):
    c = _counts(spark, d)
    return c.select("recording_id", "t", many_segments_confidence(F.col("n").cast("double"), 2.0).alias("confidence"), (F.col("n") <= 1).alias("flag"))


@query(f"WITH {COUNTS} SELECT recording_id, t, round(2 * {REACH} / (n + 1), 6) AS mean_length, round(CASE WHEN 1.0 / (n + 1) < 0.6 THEN (1.0 / (n + 1) - 0.3) / 0.3 ELSE 1.0 END, 6) AS confidence FROM counts")
def j2_a8_p7_mean_segment_length(spark, d):
    """Mean length of the pieces that the boundaries cut a window into: it telescopes to 2 w / (n + 1)."""
    c = _counts(spark, d)
    return c.select("recording_id", "t", F.round(2 * REACH / (F.col("n") + 1), 6).alias("mean_length"), F.round(long_segments_confidence(1.0 / (F.col("n") + 1), 0.3), 6).alias("confidence"))


@query(f"WITH {GRID} SELECT grid.recording_id, grid.t, count(b.t) AS n, round(coalesce(sum(b.weight), 0), 4) AS weight FROM grid LEFT JOIN boundaries b ON b.recording_id = grid.recording_id AND b.t BETWEEN grid.t - {2 * REACH} AND grid.t + {2 * REACH} GROUP BY 1, 2")
def j3_weighted_range(spark, d):
    g = J.range_pairs(grid(spark, d), boundaries(spark, d), 2 * REACH)
    return g.groupBy("recording_id", "t").agg(F.count("b_t").alias("n"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 4).alias("weight"))


TEMPO = 8


@query(f"""WITH {GRID}, w AS (SELECT grid.recording_id, grid.t, b.t - grid.t AS p, b.weight FROM grid LEFT JOIN boundaries b ON b.recording_id = grid.recording_id AND b.t BETWEEN grid.t - {2 * REACH} AND grid.t + {2 * REACH}), f AS (SELECT k::BIGINT AS k, (1 + k) / {4 * REACH} AS f FROM range({TEMPO}) x(k))
 SELECT recording_id, t, k, round(sqrt(pow(coalesce(sum(weight * cos(2 * pi() * f * p)), 0), 2) + pow(coalesce(sum(weight * sin(2 * pi() * f * p)), 0), 2)), 3) AS power FROM w, f GROUP BY 1, 2, 3""")
def f8_tempo_spectrum(spark, d):
    """Weighted sum of unit phasors of the boundaries around each grid time, for a few frequencies; an empty window is 0."""
    g = J.range_pairs(grid(spark, d), boundaries(spark, d), 2 * REACH)
    g = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TEMPO - 1).cast("long"))))
    phase = 2 * F.pi() * (1 + F.col("k")) / (4 * REACH) * (F.col("b_t") - F.col("t"))
    part = lambda f: F.pow(F.coalesce(F.sum(F.col("weight") * f(phase)), F.lit(0.0)), 2)
    return g.groupBy("recording_id", "t", "k").agg(F.round(F.sqrt(part(F.cos) + part(F.sin)), 3).alias("power"))


PAIRS = f"{SERIES}, i AS (SELECT recording_id, coalesce(lag(frame_idx) OVER (PARTITION BY recording_id ORDER BY frame_idx), 0) AS start, frame_idx AS stop FROM series WHERE label = 'click')"


@query(f"WITH {PAIRS} SELECT s.recording_id, i.start::BIGINT AS start, i.stop::BIGINT AS stop, count(*) AS n, round(avg(value), 5) AS mean FROM series s JOIN i ON s.recording_id = i.recording_id AND s.frame_idx BETWEEN i.start AND i.stop GROUP BY 1, 2, 3")
def j4_j5_points_in_intervals(spark, d):
    """Frames in closed rupture intervals: a frame on a boundary counts on both sides."""
    s = series(spark, d)
    i = S.ruptures(s.where("label = 'click'").select("recording_id", F.col("frame_idx").alias("t")))
    met = J.points_in_intervals(s.select("recording_id", "frame_idx", "value"), i, "frame_idx", 16.0)
    return met.groupBy("recording_id", "start", "stop").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@query(f"WITH {NODES}, u AS (SELECT DISTINCT recording_id, frame_idx, track_id FROM nodes) SELECT a.recording_id, a.frame_idx, a.track_id AS a, b.track_id AS b FROM u a JOIN u b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.track_id <> b.track_id")
def j6_equal_time_join(spark, d):
    return J.together(nodes(spark, d))


@query(f"WITH {NODES}, u AS (SELECT DISTINCT recording_id, frame_idx, track_id FROM nodes) SELECT a.recording_id, a.track_id AS a, b.track_id AS b, count(*) AS n FROM u a JOIN u b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.track_id <> b.track_id GROUP BY 1, 2, 3 HAVING count(*) > 3")
def j7_cooccurrence(spark, d):
    return J.linked(nodes(spark, d))


ONSETS = f"{SERIES}, o AS (SELECT s.recording_id, s.frame_idx, s.value - 50 AS score, (SELECT max(x.frame_idx) FROM series x WHERE x.recording_id = s.recording_id AND x.label = 'click' AND x.frame_idx <= s.frame_idx) AS onset FROM series s)"


@query(f"WITH {ONSETS} SELECT recording_id, onset::BIGINT AS onset_idx, round(sum(score), 4) AS total, sum(score) > 0 AS singing FROM o WHERE onset IS NOT NULL GROUP BY 1, 2")
def j8_a18_onset_sums(spark, d):
    s = series(spark, d)
    on = s.where("label = 'click'").select("recording_id", F.col("frame_idx").alias("onset_idx"))
    met = J.since_last(s.select("recording_id", "frame_idx", (F.col("value") - 50).alias("score")), on)
    return met.groupBy("recording_id", "onset_idx").agg(F.round(F.sum("score"), 4).alias("total"), (F.sum("score") > 0).alias("singing"))


@query(f"WITH {SERIES}, a AS (SELECT recording_id, value AS x, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS position FROM series WHERE label = 'click'), b AS (SELECT recording_id, value AS y, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS position FROM series WHERE label = 'view') SELECT recording_id, position, x, y FROM a JOIN b USING (recording_id, position)")
def j9_positional_zip(spark, d):
    s = series(spark, d)
    a = s.where("label = 'click'").select("recording_id", F.col("frame_idx").alias("ia"), F.col("value").alias("x"))
    b = s.where("label = 'view'").select("recording_id", F.col("frame_idx").alias("ib"), F.col("value").alias("y"))
    return J.zipped(a, b, "ia", "ib").select("recording_id", "position", "x", "y")


@query(f"WITH {SERIES}, r AS (SELECT recording_id, frame_idx, value, lead(value) OVER w AS next_value, row_number() OVER w AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)) SELECT recording_id, frame_idx, value, next_value FROM r WHERE k <= n - 2")
def j10_successors(spark, d):
    return J.successors(series(spark, d).select("recording_id", "frame_idx", "value"), "frame_idx", "value", "next_value")


@query(f"WITH {NODES}, e AS (SELECT recording_id, track_id, min(frame_idx) AS t FROM nodes GROUP BY 1, 2 UNION ALL SELECT recording_id, track_id, max(frame_idx) FROM nodes GROUP BY 1, 2) SELECT recording_id, t::BIGINT AS t, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) >= 2")
def a11_extremum_counts(spark, d):
    """Times at which at least so many tracks start or stop."""
    n = nodes(spark, d).groupBy("recording_id", "track_id").agg(F.array(F.min("frame_idx"), F.max("frame_idx")).alias("e"))
    return n.select("recording_id", F.explode("e").alias("t")).groupBy("recording_id", "t").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(f"WITH {PAIRS} SELECT s.recording_id, i.start::BIGINT AS start, round(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS ratio, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) * 1.0 / count(*) >= 0.15 AS sung FROM series s JOIN i ON s.recording_id = i.recording_id AND s.frame_idx BETWEEN i.start AND i.stop GROUP BY 1, 2")
def a12_a13_ratio_of_sums(spark, d):
    s = series(spark, d)
    i = S.ruptures(s.where("label = 'click'").select("recording_id", F.col("frame_idx").alias("t")))
    met = J.points_in_intervals(s.select("recording_id", "frame_idx", "value"), i, "frame_idx", 16.0)
    r = F.sum(F.when(F.col("value") > 60, 1).otherwise(0)) / F.count(F.lit(1))
    return met.groupBy("recording_id", "start").agg(F.round(r, 6).alias("ratio"), (r >= 0.15).alias("sung"))


@query(f"WITH {NODES} SELECT recording_id, track_id, round(avg(frequency), 4) AS centroid, min(frame_idx)::BIGINT AS start, max(frame_idx)::BIGINT AS stop FROM nodes GROUP BY 1, 2")
def a14_a15_o2_track_extent(spark, d):
    return nodes(spark, d).groupBy("recording_id", "track_id").agg(F.round(F.avg("frequency"), 4).alias("centroid"), F.min("frame_idx").alias("start"), F.max("frame_idx").alias("stop"))


@query(f"WITH {NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, frame_idx ORDER BY amplitude DESC, frequency) AS k FROM nodes) SELECT recording_id, frame_idx::BIGINT AS frame_idx, frequency, amplitude FROM r WHERE k = 1")
def a16_loudest_node(spark, d):
    best = F.max(F.struct("amplitude", (-F.col("frequency")).alias("m"))).alias("b")
    return nodes(spark, d).groupBy("recording_id", "frame_idx").agg(best).select("recording_id", "frame_idx", (-F.col("b.m")).alias("frequency"), F.col("b.amplitude").alias("amplitude"))


@query(f"WITH {NODES}, m AS (SELECT a.recording_id, a.track_id AS a, b.track_id AS b, round(avg(4 * b.frequency / a.frequency)) / 4 AS rank FROM nodes a JOIN nodes b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id GROUP BY 1, 2, 3) SELECT * FROM m WHERE rank = floor(rank)")
def a17_harmonic_rank(spark, d):
    n = nodes(spark, d)
    lo = n.select("recording_id", "frame_idx", F.col("track_id").alias("a"), F.col("frequency").alias("l"))
    hi = n.select("recording_id", "frame_idx", F.col("track_id").alias("b"), F.col("frequency").alias("u"))
    r = lo.join(hi, ["recording_id", "frame_idx"]).where("a < b").groupBy("recording_id", "a", "b").agg((F.round(F.avg(4 * F.col("u") / F.col("l"))) / 4).alias("rank"))
    return r.where("rank = floor(rank)")


@query(f"WITH {BOUNDARIES}, s AS ({SERIES[len('series AS ('):-1]}) SELECT b.recording_id, b.t, round(coalesce(sum(CASE WHEN s.t > b.t THEN abs(s.value) END), 0) - coalesce(sum(CASE WHEN s.t < b.t THEN abs(s.value) END), 0), 4) AS energy FROM boundaries b LEFT JOIN s ON s.recording_id = b.recording_id AND s.t BETWEEN b.t - {STEP} AND b.t + {STEP} GROUP BY 1, 2")
def a20_onset_energy(spark, d):
    """Absolute sum of the samples after each onset less that before it."""
    on = boundaries(spark, d).select("recording_id", "t").distinct()
    g = J.range_pairs(on, series(spark, d).select("recording_id", "t", "value"), STEP)
    side = lambda c: F.coalesce(F.sum(F.when(c, F.abs("value"))), F.lit(0.0))
    return g.groupBy("recording_id", "t").agg(F.round(side(F.col("b_t") > F.col("t")) - side(F.col("b_t") < F.col("t")), 4).alias("energy"))


@query("SELECT user_id AS recording_id, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t8_tumbling_days(spark, d):
    """Time windows over events, by the built-in window function."""
    w = F.window("ts", "1 day")
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("recording_id"), w.start.alias("day"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("day", F.col("day").cast("timestamp_ntz"))
