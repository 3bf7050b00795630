"""Sequential operators per recording, signal features, analyzers and streams: SQL cannot say most of these."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.operators import bic, changepoints, harmonic
from runnel.operators import joins as J
from runnel.operators import models as M
from runnel.operators import topk as K
from runnel.operators import windows as W
from runnel.plans import analyzers as A
from runnel.plans.graphers import grapher_sql, grapher_table
from runnel.plans.queries_models import LLK, _llh
from runnel.plans.registry import Registry
from runnel.sources.audio import frames
from runnel.sources.tables import LONG, NODES, SERIES, features, long_features, nodes, series, table

REGISTRY = Registry()
query = REGISTRY.query


def signal(spark: SparkSession, d: str) -> DataFrame:
    """recording_id, frame_idx, value: prices of each supplier's line items as a signal in [-1, 1]."""
    w = W.Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), (F.col("l_extendedprice") / 60000 - 0.5).alias("value"))


@query()
def c1_c8_divergence_cuts(spark, d):
    return changepoints.cut_recordings(signal(spark, d), 1000.0, "segment", limit=3.0, bias=0.0)


@query()
def c2_c9_hybrid_cuts(spark, d):
    return changepoints.cut_recordings(signal(spark, d), 1000.0, "hybrid")


#: From each cut the sum starts anew; its first fall under its maximum by more than the limit cuts after the maximum.
_W15 = f"""WITH RECURSIVE {SERIES}, v AS (SELECT recording_id, frame_idx, value - avg(value) OVER (PARTITION BY recording_id) AS x FROM series),
 r(recording_id, start) AS (SELECT DISTINCT recording_id, 0::BIGINT FROM v UNION ALL
  SELECT recording_id, greatest(start + 1, coalesce(min(frame_idx) FILTER (WHERE s = top AND top > 0), min(last)) + 1) FROM (
   SELECT *, max(s) OVER (PARTITION BY recording_id) AS top FROM (
    SELECT *, min(frame_idx) FILTER (WHERE fall > 100) OVER (PARTITION BY recording_id) AS last FROM (
     SELECT *, max(greatest(s, 0)) OVER (PARTITION BY recording_id ORDER BY frame_idx) - s AS fall FROM (
      SELECT r.recording_id, r.start, v.frame_idx, sum(v.x) OVER (PARTITION BY r.recording_id ORDER BY v.frame_idx) AS s FROM r JOIN v ON v.recording_id = r.recording_id AND v.frame_idx >= r.start) a) b) c
   WHERE frame_idx <= last) e GROUP BY recording_id, start)
 SELECT recording_id, frame_idx, value, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.recording_id = s.recording_id AND r.start = s.frame_idx AND r.start > 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS cut FROM series s"""


@query(_W15)
def w15_drop_test(spark, d):
    def flags(x, limit):
        out = np.zeros(len(x))
        out[[c for c in changepoints.drops(x - x.mean(), limit) if c < len(x)]] = 1
        return out

    return K.per_recording(series(spark, d).select("recording_id", "frame_idx", "value"), "value", flags, "cut", 100.0)


@query()
def b2_b3_a9_bic_votes(spark, d):
    """All 162 penalties, in the scale of these features."""
    return bic.vote(features(spark, d), [p * 5e-5 for p in bic.PENALTIES])


@query()
def b4_bic_clustering(spark, d):
    f = features(spark, d).withColumn("seg", F.col("label").cast("long"))
    return bic.cluster_segments(f.select("recording_id", "seg", "frame_idx", "f"), "seg", 0.01)


@query()
def b7_full_covariance_clustering(spark, d):
    f = features(spark, d).withColumn("seg", F.col("label").cast("long"))
    return bic.cluster_segments(f.select("recording_id", "seg", "frame_idx", "f"), "seg", 0.5, full=True)


#: Forward with back pointers (whether a unit was entered from the other one), then backward from the better end.
_M4 = f"""WITH RECURSIVE {LLK}, x AS (SELECT row_number() OVER (ORDER BY frame_idx) AS k, frame_idx, max(llh) FILTER (WHERE model_id = 0) AS s0, max(llh) FILTER (WHERE model_id = 1) AS s1 FROM llh WHERE model_id IN (0, 1) GROUP BY frame_idx),
 f(k, b0, b1, p0, p1) AS (SELECT k, s0::DOUBLE, s1::DOUBLE, false, false FROM x WHERE k = 1 UNION ALL SELECT x.k, greatest(b0, b1 - 5) + s0, greatest(b1, b0 - 5) + s1, b1 - 5 > b0, b0 - 5 > b1 FROM f JOIN x ON x.k = f.k + 1),
 e AS (SELECT k, CASE WHEN b1 > b0 THEN 1 ELSE 0 END AS u, greatest(b0, b1) / k AS score FROM f ORDER BY k DESC LIMIT 1),
 b(k, u) AS (SELECT k, u FROM e UNION ALL SELECT b.k - 1, CASE WHEN CASE b.u WHEN 0 THEN f.p0 ELSE f.p1 END THEN 1 - b.u ELSE b.u END FROM b JOIN f ON f.k = b.k WHERE b.k > 1),
 turn AS (SELECT x.k, x.frame_idx, b.u, CASE WHEN lag(b.u) OVER (ORDER BY x.k) = b.u THEN 0 ELSE 1 END AS n FROM b JOIN x ON x.k = b.k),
 held AS (SELECT *, sum(n) OVER (ORDER BY k) AS run FROM turn)
 SELECT 0::BIGINT AS recording_id, min(frame_idx) AS start_idx, count(*) AS n, min(u)::INT AS model_id, round((SELECT score FROM e), 6) AS score FROM held GROUP BY run"""


@query(_M4)
def m4_viterbi(spark, d):
    return M.viterbi(_llh(spark, d), [0, 1], 5.0).withColumn("score", F.round("score", 6))


_O7 = f"""WITH RECURSIVE {SERIES}, l AS (SELECT recording_id, list(value ORDER BY frame_idx) AS v FROM series GROUP BY 1),
 r(recording_id, v, i, decision) AS (SELECT recording_id, v, NULL::BIGINT, NULL::DOUBLE FROM l UNION ALL
  SELECT recording_id, list_transform(v, lambda x, k: CASE WHEN k >= i - 5 AND k < i + 5 THEN 0.0::DOUBLE ELSE x END), i, list_sum(v[greatest(1, i - 5):i + 4]) FROM (SELECT recording_id, v, list_position(v, list_max(v))::BIGINT AS i FROM r WHERE list_max(v) > 0) q)
 SELECT s.recording_id, s.frame_idx, s.value, round(decision, 6) AS decision FROM r JOIN series s ON s.recording_id = r.recording_id AND s.frame_idx = r.i - 1 WHERE i IS NOT NULL"""


@query(_O7)
def o7_peak_suppression(spark, d):
    s = series(spark, d).select("recording_id", "frame_idx", "value")
    return K.per_recording(s, "value", K.suppressed, "decision", 5).where("decision > 0").withColumn("decision", F.round("decision", 6))


_O8 = f"""WITH RECURSIVE {LONG}, w AS (SELECT frame_idx, dim, avg(x) OVER l AS m1, stddev_pop(x) OVER l AS s1, count(x) OVER l AS n1, avg(x) OVER r AS m2, stddev_pop(x) OVER r AS s2, count(x) OVER r AS n2 FROM long
 WINDOW l AS (PARTITION BY dim ORDER BY frame_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY dim ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
 d AS (SELECT row_number() OVER (ORDER BY frame_idx) AS k, frame_idx, round(sum((m1 - m2) * (m1 - m2) / (s1 * s2)), 6) AS v FROM w WHERE n1 = 20 AND n2 = 20 GROUP BY frame_idx),
 p(lo, hi, top) AS (SELECT min(k), max(k), first(k ORDER BY v DESC, k) FROM d UNION ALL
  SELECT q.lo, q.hi, first(d.k ORDER BY d.v DESC, d.k) FROM (SELECT lo, top - 21 AS hi FROM p UNION ALL SELECT top + 21 AS lo, hi FROM p) q JOIN d ON d.k BETWEEN q.lo AND q.hi GROUP BY q.lo, q.hi)
 SELECT 0::BIGINT AS recording_id, d.frame_idx FROM p JOIN d ON d.k = p.top"""


@query(_O8)
def o8_recursive_cuts(spark, d):
    g = W.two_sided_divergence(long_features(spark, d), 20).withColumn("divergence", F.round("divergence", 6))
    return K.per_recording(g, "divergence", K.recursive_cuts, "cut", 20).where("cut = 1").select("recording_id", "frame_idx")


_U5 = f"""WITH RECURSIVE {NODES}, u AS (SELECT DISTINCT recording_id, frame_idx, track_id FROM nodes), e AS (SELECT a.recording_id, a.track_id AS a, b.track_id AS b FROM u a JOIN u b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.track_id <> b.track_id GROUP BY 1, 2, 3 HAVING count(*) > 3),
 r AS (SELECT recording_id, a AS node, a AS other FROM e UNION SELECT r.recording_id, r.node, e.b FROM r JOIN e ON r.recording_id = e.recording_id AND r.other = e.a) SELECT recording_id, node, min(other) AS component FROM r GROUP BY 1, 2"""


@query(_U5)
def u5_j7_components(spark, d):
    return harmonic.components(J.linked(nodes(spark, d)))


@query()
def h2_peak_tracking(spark, d):
    top = K.top_k(nodes(spark, d), ["recording_id", "frame_idx"], "amplitude", "frequency", 5)
    return harmonic.track(top.select("recording_id", "frame_idx", "rank", "frequency", "amplitude"), 2)


@query()
def h3_harmonic_groups(spark, d):
    n = nodes(spark, d)
    comp = harmonic.components(J.linked(n)).withColumnRenamed("node", "track_id")
    return harmonic.group_tracks(n.join(comp, ["recording_id", "track_id"]))


@query(grapher_sql())
def s12_graphers(spark, d):
    return grapher_table(spark)


def _toy_gmm(spark: SparkSession, names: list[str], dims: int) -> DataFrame:
    rng = np.random.default_rng(2)
    rows = [(n, k, 0.5, rng.normal(size=dims).tolist(), (1 + rng.random(dims)).tolist()) for n in names for k in range(2)]
    return spark.createDataFrame(rows, "model_id string, k int, weight double, mu array<double>, var array<double>")


def signal_blocks(spark: SparkSession, d: str, block: int = 100) -> DataFrame:
    """The suppliers' signals as blocks of samples at 1000 a second."""
    cut = signal(spark, d).groupBy(F.col("recording_id").cast("string").alias("recording_id"), F.floor(F.col("frame_idx") / block).alias("block_idx"))
    return cut.agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))), lambda x: x.value).alias("samples")).withColumn("sample_rate", F.lit(1000)).withColumn("channels", F.lit(1))


_T2 = """WITH s AS (SELECT l_suppkey AS r, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS k, l_extendedprice / 60000 - 0.5 AS x FROM lineitem),
 f AS (SELECT r, k, sum(x * x) OVER w AS e, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 255 FOLLOWING))
 SELECT r::VARCHAR AS recording_id, (k // 128)::BIGINT AS frame_idx, k / 1000.0::DOUBLE AS t, round(e, 6) AS energy FROM f WHERE n = 256 AND k % 128 = 0"""


@query(_T2)
def t2_reblocking(spark, d):
    f = frames(signal_blocks(spark, d), 256, 128)
    return f.select("recording_id", "frame_idx", "t", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))


def recordings(spark: SparkSession, d: str, block: int = 4096) -> DataFrame:
    """Three recordings, one of each return flag: prices of all line items in order of shipping, as samples."""
    w = W.Window.partitionBy("l_returnflag").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("recording_id"), (F.row_number().over(w) - 1).alias("k"), (F.col("l_extendedprice") / 60000 - 0.5).alias("value"))
    cut = x.groupBy("recording_id", F.floor(F.col("k") / block).alias("block_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s.value).alias("samples"))
    return cut.withColumn("sample_rate", F.lit(16000)).withColumn("channels", F.lit(1))


def _analysis(id: str, result: str, **more):
    def run(spark, d):
        ctx = A.Context(recordings(spark, d), 16000)
        if "gmm" in more:
            ctx.gmm = _toy_gmm(spark, *more["gmm"])
        if "prototypes" in more:
            ctx.prototypes = more["prototypes"]
        if "onsets" in more:
            ctx.onsets = spark.createDataFrame([(r, t) for r in ("A", "N", "R") for t in more["onsets"]], "recording_id string, t double")
        return A.run(id, ctx, **more.get("options", {}))[result]

    run.__name__ = f"analyzer_{id}"
    return query()(run)


_SAD_MODEL = (["speech", "nonspeech"], 40)
for _id, _result, _more in [
    ("irit_speech_4hz", "irit_speech_4hz.segments_median", {}), ("irit_speech_entropy", "irit_speech_entropy.segments", {"options": {"blocksize": 256}}),
    ("irit_diverg", "irit_diverg.segments", {}), ("irit_diverg2", "irit_diverg2.segments", {}), ("irit_music_snb", "irit_music_snb.segments", {}), ("irit_music_sln", "irit_music_sln.segments", {}),
    ("irit_tempogram", "irit_tempogram", {}), ("irit_startseg", "irit_startseg.segments", {"prototypes": [[0.2, 0.1, 0.05], [0.1, 0.1, 0.1]]}), ("irit_singing_turns", "irit_singing_turns", {}),
    ("irit_harmo_tracking", "irit_harmo_tracking", {}), ("irit_harmo_cluster", "irit_harmo_cluster", {}), ("irit_monopoly", "irit_monopoly.segments", {}), ("irit_singing", "irit_singing.segments", {}),
    ("limsi_sad", "limsi_sad.sad_segments", {"gmm": _SAD_MODEL}), ("limsi_diarization", "limsi_diarization.speakers", {"gmm": _SAD_MODEL}),
    ("labri_speech_music_noise", "labri_speech_music_noise.speech", {"gmm": (["speech.a", "music.b", "noise.c"], 39)}), ("labri_singing", "labri_singing", {"gmm": (["sing", "nosing"], 39), "onsets": [0.5, 1.2, 2.0]}),
]:
    _analysis(_id, _result, **_more)
