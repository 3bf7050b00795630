"""Window operators over the events' series and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from runnel.operators import segments as S
from runnel.operators import windows as W
from runnel.plans.registry import Registry
from runnel.sources.tables import LONG, SERIES, long_features, series

REGISTRY = Registry()
query = REGISTRY.query
OVER = "OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN {} AND {})"
ALL = "OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
O = "OVER (PARTITION BY recording_id ORDER BY frame_idx)"  # noqa: E741

_MOD = f"""{SERIES}, raw AS (SELECT *, row_number() {O} - 1 AS i, count(*) {ALL} AS n,
  var_pop(ln(CASE WHEN value <= 0 THEN 1.1920929e-07 ELSE value END)) {OVER.format('4 PRECEDING', '3 FOLLOWING')} AS v0 FROM series),
 cored AS (SELECT *, CASE WHEN i >= 4 AND i < n - 4 THEN round(v0, 6) END AS v FROM raw),
 modulated AS (SELECT recording_id, frame_idx, value, label, coalesce(v, CASE WHEN i < 4 THEN first_value(v IGNORE NULLS) {ALL} ELSE last_value(v IGNORE NULLS) {ALL} END) AS modulation FROM cored)"""
_FLAG = f"{SERIES}, flags AS (SELECT recording_id, frame_idx, value, value > 50 AS flag FROM series)"


def _modulated(spark, d):
    return W.modulation(series(spark, d), 8, digits=6)


@query(f"""WITH {_MOD}, dec AS (SELECT recording_id, frame_idx, modulation > 1.0 AS on0 FROM modulated),
 med AS (SELECT recording_id, frame_idx, sum(on0::INT) {OVER.format('4 PRECEDING', '4 FOLLOWING')} >= 5 AS label FROM dec),
 c AS (SELECT *, CASE WHEN lag(label) {O} = label THEN 0 ELSE 1 END AS ch FROM med),
 r AS (SELECT *, sum(ch) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} - 1 AS seg FROM c)
 SELECT recording_id, seg::BIGINT AS seg_idx, min(frame_idx)::BIGINT AS start_idx, max(frame_idx)::BIGINT AS end_idx, label FROM r GROUP BY recording_id, seg, label""")
def entry_segments(spark, d):
    """Modulation, threshold, median majority and runs: the speech-activity recipe on events."""
    m = _modulated(spark, d).withColumn("on0", F.col("modulation") > 1.0)
    return S.runs(W.majority(m, "on0", 9, "label"), "label")


@query(f"WITH {_MOD} SELECT recording_id, frame_idx, modulation FROM modulated")
def w1_modulation(spark, d):
    return _modulated(spark, d).select("recording_id", "frame_idx", "modulation")


@query(f"""WITH {SERIES}, raw AS (SELECT *, row_number() {O} - 1 AS i, count(*) {ALL} AS n, var_pop(value) {OVER.format('5 PRECEDING', '4 FOLLOWING')} AS v0 FROM series),
 c AS (SELECT *, CASE WHEN i >= 5 AND i < n - 5 THEN round(v0, 6) END AS v FROM raw)
 SELECT recording_id, frame_idx, coalesce(v, CASE WHEN i < 5 THEN first_value(v IGNORE NULLS) {ALL} ELSE last_value(v IGNORE NULLS) {ALL} END) AS modulation FROM c""")
def w1_modulation_linear(spark, d):
    m = W.modulation(series(spark, d), 10, log=False, digits=6)
    return m.select("recording_id", "frame_idx", "modulation")


@query(f"WITH {_FLAG} SELECT recording_id, frame_idx, sum(flag::INT) {OVER.format('2 PRECEDING', '2 FOLLOWING')} >= 3 AS median FROM flags")
def w2_median_majority(spark, d):
    f = series(spark, d).withColumn("flag", F.col("value") > 50)
    return W.majority(f, "flag", 5).select("recording_id", "frame_idx", "median")


@query(f"WITH {SERIES} SELECT recording_id, frame_idx, max(value) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS high, min(value) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS low FROM series")
def w4_w5_dilate_erode(spark, d):
    s = W.dilate(series(spark, d), "value", 12, "high")
    return W.erode(s, "value", 12, "low").select("recording_id", "frame_idx", "high", "low")


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() {O} - 1 AS i, count(*) {ALL} AS n, first_value(value) {ALL} AS a, last_value(value) {ALL} AS b, sum(value) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS s FROM series)
 SELECT recording_id, frame_idx, round((s + greatest(0, 6 - i) * a + greatest(0, i + 5 - (n - 1)) * b) / 12, 5) AS smooth FROM r""")
def w6_smooth(spark, d):
    return W.smooth(series(spark, d), "value", 12, "smooth").select("recording_id", "frame_idx", F.round("smooth", 5).alias("smooth"))


@query(f"""WITH {SERIES}, a AS (SELECT *, max(value) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS va FROM series), b AS (SELECT *, min(va) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS vb FROM a),
 c AS (SELECT *, min(vb) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS vc FROM b) SELECT recording_id, frame_idx, max(vc) {OVER.format('6 PRECEDING', '5 FOLLOWING')} AS deed FROM c""")
def w7_dilate_erode_erode_dilate(spark, d):
    return W.dilate_erode(series(spark, d), "value", 12, "deed").select("recording_id", "frame_idx", "deed")


@query(f"""WITH {_FLAG}, c AS (SELECT *, CASE WHEN lag(flag) {O} = flag THEN 0 ELSE 1 END AS ch FROM flags), r AS (SELECT *, sum(ch) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS run FROM c)
 SELECT recording_id, frame_idx, flag AND count(*) OVER (PARTITION BY recording_id, run) >= 3 AS opened FROM r""")
def w8_opening(spark, d):
    """Erosion and dilation; the SQL drops short runs, which is the same."""
    f = series(spark, d).withColumn("flag", F.col("value") > 50)
    return W.opening(f, "flag", 3, "opened").select("recording_id", "frame_idx", F.coalesce("opened", F.lit(False)).alias("opened"))


@query(f"""WITH {_FLAG}, a AS (SELECT *, max(flag::INT) {OVER.format('1 PRECEDING', '2 FOLLOWING')} AS m FROM flags)
 SELECT recording_id, frame_idx, sum(m) {OVER.format('2 PRECEDING', '1 FOLLOWING')} = 4 AS closed FROM a""")
def w8_closing(spark, d):
    f = series(spark, d).withColumn("flag", F.col("value") > 50)
    return W.closing(f, "flag", 4, "closed").select("recording_id", "frame_idx", "closed")


@query(f"""WITH {LONG}, r AS (SELECT frame_idx, dim, avg(x) OVER l AS m1, stddev_pop(x) OVER l AS s1, count(x) OVER l AS n1, avg(x) OVER r AS m2, stddev_pop(x) OVER r AS s2, count(x) OVER r AS n2 FROM long
 WINDOW l AS (PARTITION BY dim ORDER BY frame_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY dim ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
 SELECT 0::BIGINT AS recording_id, frame_idx, round(sum((m1 - m2) * (m1 - m2) / (s1 * s2)), 3) AS divergence FROM r WHERE n1 = 20 AND n2 = 20 GROUP BY frame_idx""")
def w9_two_sided_divergence(spark, d):
    g = W.two_sided_divergence(long_features(spark, d), 20)
    return g.select("recording_id", "frame_idx", F.round("divergence", 3).alias("divergence"))


@query(f"""WITH {SERIES}, r AS (SELECT *, row_number() {O} - 1 AS i, count(*) {ALL} AS n, quantile_cont(value, 0.5) {OVER.format('2 PRECEDING', '1 FOLLOWING')} AS m FROM series)
 SELECT recording_id, frame_idx, round(CASE WHEN i >= 2 AND i < n - 2 THEN m ELSE 0.0 END, 6) AS smoothed FROM r""")
def w10_note_smoothing(spark, d):
    return W.median_of(series(spark, d), "value", 5, "smoothed").select("recording_id", "frame_idx", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH {SERIES}, r AS (SELECT recording_id, frame_idx, avg(value) {OVER.format('CURRENT ROW', '9 FOLLOWING')} AS m, var_pop(value) {OVER.format('CURRENT ROW', '9 FOLLOWING')} + 1e-15 AS v, count(*) {OVER.format('CURRENT ROW', '9 FOLLOWING')} AS n FROM series)
 SELECT recording_id, frame_idx, round(m, 5) AS mean, round(v, 6) AS variance FROM r WHERE n = 10""")
def w11_short_window_statistics(spark, d):
    w = W.by_frame().rowsBetween(0, 9)
    r = series(spark, d).select("recording_id", "frame_idx", F.avg("value").over(w).alias("mean"), (F.var_pop("value").over(w) + 1e-15).alias("variance"), F.count("value").over(w).alias("n"))
    return r.where("n = 10").select("recording_id", "frame_idx", F.round("mean", 5).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"""WITH {SERIES}, c AS (SELECT *, CASE WHEN lag(label) {O} = label THEN 0 ELSE 1 END AS ch FROM series), r AS (SELECT *, sum(ch) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} - 1 AS seg FROM c)
 SELECT recording_id, seg::BIGINT AS seg_idx, label, min(frame_idx)::BIGINT AS start_idx, max(frame_idx)::BIGINT AS end_idx FROM r GROUP BY ALL""")
def w12_runs(spark, d):
    return S.runs(series(spark, d), "label")


@query(f"""WITH {SERIES}, r AS (SELECT recording_id, frame_idx, value, row_number() OVER (PARTITION BY recording_id ORDER BY value, frame_idx) - 1 AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM series)
 SELECT recording_id, frame_idx, CASE WHEN k >= floor(n * 0.01 + 1e-9) AND k < floor(n * 0.2 + 1e-9) THEN 0 ELSE 1 END::INT AS side FROM r
 WHERE (k >= floor(n * 0.01 + 1e-9) AND k < floor(n * 0.2 + 1e-9)) OR (k >= floor(n * 0.8 + 1e-9) AND k < floor(n * 0.99 + 1e-9))""")
def w13_rank_slices(spark, d):
    return W.rank_slices(series(spark, d), "value", 0.01, 0.2).select("recording_id", "frame_idx", "side")


@query(f"""WITH {SERIES}, r AS (SELECT *, first_value(value) {ALL} AS a, last_value(value) {ALL} AS b FROM series)
 SELECT recording_id, frame_idx, round((coalesce(lead(value, 1) {O}, b) - coalesce(lag(value, 1) {O}, a) + 2 * (coalesce(lead(value, 2) {O}, b) - coalesce(lag(value, 2) {O}, a))) / 10, 6) AS slope FROM r""")
def f23_derivative(spark, d):
    return W.derivative(series(spark, d), "value", 2, "slope").select("recording_id", "frame_idx", F.round("slope", 6).alias("slope"))


@query(f"WITH {SERIES} SELECT recording_id, frame_idx, round(value * frame_idx / nullif(sum(CASE WHEN frame_idx > 0 THEN value END) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')}, 0), 6) AS cumulated FROM series WHERE frame_idx > 0")
def w14_cumulative_mean(spark, d):
    """Each value by the running mean of those up to it, from frame 1."""
    w = W.by_frame().rowsBetween(W.Window.unboundedPreceding, 0)
    s = series(spark, d).where("frame_idx > 0")
    return s.select("recording_id", "frame_idx", F.round(F.col("value") * F.col("frame_idx") / F.nullif(F.sum("value").over(w), F.lit(0.0)), 6).alias("cumulated"))
