"""Gaussian mixtures, adaptation and monophony."""

from __future__ import annotations

from pyspark.sql import functions as F

from runnel.functions.columns import WEIBULL_MONO, WEIBULL_POLY, weibull
from runnel.operators import models as M
from runnel.operators import windows as W
from runnel.plans.queries_windows import OVER
from runnel.plans.registry import Registry
from runnel.sources.tables import LONG, SERIES, features, long_features, series

REGISTRY = Registry()
query = REGISTRY.query

#: Two mixtures of five Gaussians: even and odd labels.
GMM = f"{LONG}, g AS (SELECT label % 2 AS model_id, label AS k, dim, avg(x) AS mu, var_pop(x) AS var FROM long GROUP BY 1, 2, 3)"
LLK = f"{GMM}, c AS (SELECT frame_idx, model_id, k, -0.5 * sum(ln(2 * pi() * var) + (x - mu) * (x - mu) / var) AS ll FROM long JOIN g USING (dim) GROUP BY 1, 2, 3), m AS (SELECT frame_idx, model_id, max(ll) AS top FROM c GROUP BY 1, 2), llh AS (SELECT frame_idx, model_id, top + ln(sum(exp(ll - top))) AS llh FROM c JOIN m USING (frame_idx, model_id) GROUP BY frame_idx, model_id, top)"


def gmm(spark, d):
    g = M.gaussians(long_features(spark, d).withColumn("model", F.col("label") % 2), "label").withColumn("model", F.col("label") % 2)
    return M.mixture(g, "model", "label")


def _llh(spark, d):
    return M.log_likelihood(features(spark, d), gmm(spark, d))


@query(f"WITH {LLK} SELECT 0::BIGINT AS recording_id, frame_idx, model_id, round(llh, 4) AS llh FROM llh")
def m1_a5_j11_gmm_llh(spark, d):
    return _llh(spark, d).select("recording_id", "frame_idx", "model_id", F.round("llh", 4).alias("llh"))


@query(f"WITH {LLK} SELECT 0::BIGINT AS recording_id, a.frame_idx, round(0.5 + 0.5 * (a.llh - b.llh), 4) AS llr FROM llh a JOIN llh b USING (frame_idx) WHERE a.model_id = 1 AND b.model_id = 0")
def m2_log_ratio(spark, d):
    return M.log_ratio(_llh(spark, d), 1, 0).select("recording_id", "frame_idx", F.round("llr", 4).alias("llr"))


@query(f"""WITH {LLK}, llr AS (SELECT a.frame_idx, round(0.5 + 0.5 * (a.llh - b.llh), 4) AS llr FROM llh a JOIN llh b USING (frame_idx) WHERE a.model_id = 1 AND b.model_id = 0),
 r AS (SELECT frame_idx, row_number() OVER (ORDER BY llr, frame_idx) - 1 AS k, count(*) OVER () AS n FROM llr),
 s AS (SELECT frame_idx, CASE WHEN k >= floor(n * 0.01 + 1e-9) AND k < floor(n * 0.2 + 1e-9) THEN 0 WHEN k >= floor(n * 0.8 + 1e-9) AND k < floor(n * 0.99 + 1e-9) THEN 1 END AS side FROM r),
 t AS (SELECT side, dim, avg(x) AS mu, var_pop(x) AS var FROM long JOIN s USING (frame_idx) WHERE side IS NOT NULL GROUP BY 1, 2)
 SELECT 0::BIGINT AS recording_id, frame_idx, round(0.5 + 0.5 * sum(CASE WHEN side = 1 THEN 1 ELSE -1 END * -0.5 * (ln(2 * pi() * var) + (x - mu) * (x - mu) / var)), 3) AS llr FROM long JOIN t USING (dim) GROUP BY frame_idx""")
def m3_adaptation(spark, d):
    """One Gaussian for each side, trained on the confident frames, scores all frames anew."""
    first = M.log_ratio(_llh(spark, d), 1, 0).withColumn("llr", F.round("llr", 4))
    sides = W.rank_slices(first, "llr", 0.01, 0.2).select("recording_id", "frame_idx", "side")
    long = long_features(spark, d)
    trained = long.join(sides, ["recording_id", "frame_idx"]).groupBy("recording_id", "side", "dim").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
    return M.gaussian_ratio(long, trained, ["recording_id", "frame_idx"]).select("recording_id", "frame_idx", F.round("llr", 3).alias("llr"))


def _weibull_sql(p) -> str:
    t1, t2, b1, b2, d = p
    s0 = f"(pow(m / {t1}, {b1 / d!r}) + pow(v / {t2}, {b2 / d!r}))"
    return f"ln({b1 * b2 / (t1 * t2)!r}) + {b1 / d - 1!r} * ln(m / {t1}) + {b2 / d - 1!r} * ln(v / {t2}) + {d - 2!r} * ln({s0}) + ln(pow({s0}, {d}) + {1 / d - 1!r}) - pow({s0}, {d})"


_STATS = f"{SERIES}, s AS (SELECT recording_id, frame_idx, avg(value / 100) {OVER.format('CURRENT ROW', '9 FOLLOWING')} AS m, var_pop(value / 100) {OVER.format('CURRENT ROW', '9 FOLLOWING')} + 1e-15 AS v, count(*) {OVER.format('CURRENT ROW', '9 FOLLOWING')} AS n FROM series)"


@query(f"WITH {_STATS} SELECT recording_id, frame_idx, round({_weibull_sql(WEIBULL_MONO)}, 5) AS mono, round({_weibull_sql(WEIBULL_POLY)}, 5) AS poly FROM s WHERE n = 10 AND m > 0")
def m5_weibull(spark, d):
    w = W.by_frame().rowsBetween(0, 9)
    s = series(spark, d).withColumn("x", F.col("value") / 100)
    r = s.select("recording_id", "frame_idx", F.avg("x").over(w).alias("m"), (F.var_pop("x").over(w) + 1e-15).alias("v"), F.count("x").over(w).alias("n")).where("n = 10 and m > 0")
    return r.select("recording_id", "frame_idx", F.round(weibull("m", "v", WEIBULL_MONO), 5).alias("mono"), F.round(weibull("m", "v", WEIBULL_POLY), 5).alias("poly"))


@query(f"""WITH {_STATS}, n AS (SELECT recording_id, count(*) AS total FROM series GROUP BY 1), b AS (SELECT recording_id, unnest(range(0, (total - 50) // 25 + 1)) AS block_idx FROM n WHERE total >= 50)
 SELECT recording_id, block_idx, round(avg({_weibull_sql(WEIBULL_MONO)}), 5) AS mono, round(avg({_weibull_sql(WEIBULL_POLY)}), 5) AS poly, (avg({_weibull_sql(WEIBULL_MONO)}) > avg({_weibull_sql(WEIBULL_POLY)}))::INT AS label
 FROM b JOIN s USING (recording_id) WHERE s.n = 10 AND m > 0 AND frame_idx >= block_idx * 25 AND frame_idx < block_idx * 25 + 40 GROUP BY 1, 2""")
def m6_monophony(spark, d):
    s = series(spark, d).withColumn("x", F.col("value") / 100)
    return M.monophony(s, "x").select("recording_id", "block_idx", F.round("mono", 5).alias("mono"), F.round("poly", 5).alias("poly"), "label")
