"""Projections, predicates, features and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runnel.functions import columns as C
from runnel.operators import statistics as A
from runnel.operators import topk as K
from runnel.operators import windows as W
from runnel.plans.queries_windows import ALL, O
from runnel.plans.registry import Registry
from runnel.sources.tables import LONG, NODES, SERIES, features, long_features, nodes, series, table

REGISTRY = Registry()
query = REGISTRY.query
ARR = "list_transform(embedding, lambda x: x::DOUBLE)"


def _e(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"), "label")


@query(f"SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first_channel, round(list_sum({ARR}) / len(embedding), 6) AS mono FROM embeddings")
def p1_p2_channels(spark, d):
    """First channel, and the mean over channels."""
    return _e(spark, d).select("vec_id", F.round(F.element_at("f", 1), 6).alias("first_channel"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x) / F.size("f"), 6).alias("mono"))


@query("SELECT vec_id, trunc(greatest(-32768, least(32767, embedding[1]::DOUBLE * 32768)))::SMALLINT AS pcm FROM embeddings")
def p3_quantize(spark, d):
    return _e(spark, d).select("vec_id", C.int16(F.element_at("f", 1)).alias("pcm"))


@query(f"WITH {SERIES} SELECT recording_id, frame_idx, value > 50 AS on0, round(least((value - 50) / 50, 1.0), 6) AS confidence, greatest(-10.0, least(10.0, value - 50))::DOUBLE AS clipped FROM series")
def p4_p5_p8_threshold_confidence_clip(spark, d):
    s = series(spark, d)
    return s.select("recording_id", "frame_idx", (F.col("value") > 50).alias("on0"), F.round(C.confidence("value", 50.0), 6).alias("confidence"), C.clip(F.col("value") - 50, -10.0, 10.0).alias("clipped"))


@query(f"WITH {SERIES} SELECT recording_id, frame_idx, row_number() {O} - 1 AS compact_idx FROM series WHERE value > 50 AND t BETWEEN 1704067200 AND 1735689600")
def p9_p10_interval_and_voiced_filter(spark, d):
    s = series(spark, d).where((F.col("value") > 50) & F.col("t").between(1704067200, 1735689600))
    return s.select("recording_id", "frame_idx", (F.row_number().over(W.by_frame()) - 1).cast("long").alias("compact_idx"))


@query(f"WITH {SERIES}, r AS (SELECT *, lag(value) {O} AS b, lead(value) {O} AS a FROM series) SELECT recording_id, frame_idx, value FROM r WHERE value > b AND value > a")
def p11_local_maxima(spark, d):
    return K.local_maxima(series(spark, d), "value").select("recording_id", "frame_idx", "value")


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS head, contains(p_type, 'BRASS') AS brass FROM part")
def p12_f20_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring_index("p_type", " ", 1).alias("head"), F.contains("p_type", F.lit("BRASS")).alias("brass"))


@query("SELECT a.vec_id, len(a.embedding)::BIGINT + len(b.embedding)::BIGINT AS dims, round(a.embedding[64]::DOUBLE, 6) AS x64, round(b.embedding[1]::DOUBLE, 6) AS x65 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def p13_feature_concatenation(spark, d):
    e = _e(spark, d)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("f").alias("g"))
    c = e.join(nxt, "vec_id").select("vec_id", F.concat("f", "g").alias("c"))
    return c.select("vec_id", F.size("c").cast("long").alias("dims"), F.round(F.element_at("c", 64), 6).alias("x64"), F.round(F.element_at("c", 65), 6).alias("x65"))


@query(f"WITH {SERIES}, r AS (SELECT recording_id, frame_idx, value, CASE WHEN lead(frame_idx) {O} IS NULL THEN 0 ELSE value END AS patched FROM series) SELECT recording_id, frame_idx, round(patched / nullif(max(patched) {ALL}, 0), 6) AS by_max, round(value / nullif(avg(value) {ALL}, 0), 6) AS by_mean FROM r")
def p14_p15_p16_normalize(spark, d):
    """By the maximum, the last value taken as 0 first; by the mean."""
    s = series(spark, d).withColumn("patched", F.when(F.lead("frame_idx").over(W.by_frame()).isNull(), 0.0).otherwise(F.col("value")))
    return s.select("recording_id", "frame_idx", F.round(F.col("patched") / F.nullif(F.max("patched").over(W.whole()), F.lit(0.0)), 6).alias("by_max"), F.round(F.col("value") / F.nullif(F.avg("value").over(W.whole()), F.lit(0.0)), 6).alias("by_mean"))


@query(f"WITH {SERIES} SELECT recording_id, frame_idx, round(CASE WHEN value > 0 THEN ln(value) ELSE -1e9 END, 6) AS logged, CASE WHEN value > 50 THEN 'Speech' ELSE 'NonSpeech' END AS name FROM series")
def p17_p18_log_and_label(spark, d):
    s = series(spark, d)
    logged = F.when(C.ln0("value") == float("-inf"), F.lit(-1e9)).otherwise(C.ln0("value"))
    names = F.create_map(F.lit(1), F.lit("Speech"), F.lit(0), F.lit("NonSpeech"))
    return s.select("recording_id", "frame_idx", F.round(logged, 6).alias("logged"), F.element_at(names, (F.col("value") > 50).cast("int")).alias("name"))


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({ARR}, lambda x: x * x)) / len(embedding)), 6) AS rms, round((SELECT count(*) FROM (SELECT unnest(range(1, 64)) AS i) q WHERE embedding[i]::DOUBLE * embedding[i + 1]::DOUBLE < 0) / 64.0, 6) AS zcr FROM embeddings")
def a1_f24_f25_energy_and_crossings(spark, d):
    return _e(spark, d).select("vec_id", F.round(C.rms("f"), 6).alias("rms"), F.round(C.zero_crossings("f"), 6).alias("zcr"))


@query(f"WITH {LONG} SELECT label, dim, round(avg(x), 6) AS mu, round(var_pop(x), 6) AS var FROM long GROUP BY 1, 2")
def a2_gaussian_training(spark, d):
    return long_features(spark, d).groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mu"), F.round(F.var_pop("x"), 6).alias("var"))


@query(f"WITH {LONG}, v AS (SELECT label, dim, var_pop(x) AS v FROM long GROUP BY 1, 2) SELECT label, round(sum(ln(v)), 5) AS logdet FROM v GROUP BY 1")
def a3_log_determinant(spark, d):
    return A.log_determinant(long_features(spark, d), ["label"]).select("label", F.round("logdet", 5).alias("logdet"))


@query(f"WITH {LONG}, r AS (SELECT frame_idx // 25 AS k, dim, var_pop(x) AS v FROM long GROUP BY 1, 2) SELECT k::BIGINT AS k, round(sum(v), 5) AS total FROM r GROUP BY 1")
def a4_range_variance(spark, d):
    """Variance of each 25-frame range, from differences of running sums."""
    p = A.prefix_sums(long_features(spark, d)).withColumn("k", F.expr("frame_idx div 25"))
    ends = p.groupBy("k", "dim").agg(F.max(F.struct("n", "s", "q")).alias("e"))
    o = Window.partitionBy("dim").orderBy("k")
    zero = lambda c: F.coalesce(F.lag(f"e.{c}").over(o), F.lit(0))
    r = ends.select("k", "dim", (F.col("e.n") - zero("n")).alias("n"), (F.col("e.s") - zero("s")).alias("s"), (F.col("e.q") - zero("q")).alias("q"))
    return r.groupBy("k").agg(F.round(F.sum(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)), 5).alias("total"))


@query(f"""WITH {SERIES}, w AS (SELECT recording_id, value AS v, min(value) OVER (PARTITION BY recording_id) AS lo, (max(value) OVER (PARTITION BY recording_id) - min(value) OVER (PARTITION BY recording_id)) / 10 AS s FROM series),
 b AS (SELECT recording_id, s, least(floor((v - lo) / s), 9) AS b, count(*) AS c FROM w GROUP BY 1, 2, 3)
 SELECT recording_id, round(-sum(c * ln(c)) / sum(c) + ln(sum(c)) + ln(max(s)) - (-9.0) / (2 * sum(c)), 6) AS entropy FROM b GROUP BY 1""")
def a6_f5_entropy(spark, d):
    return A.histogram_entropy(series(spark, d), "value").select("recording_id", F.round("entropy", 6).alias("entropy"))


@query(f"WITH {SERIES} SELECT recording_id, round(quantile_cont(value, 0.9), 6) AS p90 FROM series GROUP BY 1")
def a10_percentile(spark, d):
    return series(spark, d).groupBy("recording_id").agg(F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query(f"WITH {SERIES} SELECT recording_id, label, round(count(*) / 162.0, 6) AS density FROM series GROUP BY 1, 2 HAVING count(*) >= 3")
def a9_vote_density(spark, d):
    g = series(spark, d).groupBy("recording_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return g.select("recording_id", "label", F.round(F.col("n") / 162.0, 6).alias("density"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * i / 64.0)), 5) AS weighted, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63)))), 5) AS hamming FROM embeddings")
def f3_f7_band_weights(spark, d):
    """Fixed dot product over bands, and a Hamming-weighted sum."""
    return _e(spark, d).select("vec_id", F.round(C.dot("f", [k / 64 for k in range(1, 65)]), 5).alias("weighted"), F.round(F.aggregate(C.windowed("f", 64), F.lit(0.0), lambda a, x: a + x), 5).alias("hamming"))


@query(f"WITH {NODES}, p AS (SELECT *, lag(frequency) OVER w AS f0, lag(amplitude) OVER w AS a0 FROM nodes WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx, frequency, amplitude)) SELECT recording_id, track_id, count(*) AS n, round(avg(sqrt(pow(12 * (log2(frequency / 13.75) - log2(f0 / 13.75)), 2) + pow((log10(amplitude) - log10(a0)) / 3, 2))), 5) AS distance, round(avg(greatest(frequency, f0) / least(frequency, f0)), 5) AS ratio FROM p WHERE f0 IS NOT NULL GROUP BY 1, 2")
def h1_f15_f16_node_distance(spark, d):
    o = Window.partitionBy("recording_id", "track_id").orderBy("frame_idx", "frequency", "amplitude")
    p = nodes(spark, d).withColumn("f0", F.lag("frequency").over(o)).withColumn("a0", F.lag("amplitude").over(o)).where("f0 is not null")
    return p.groupBy("recording_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C.node_distance("frequency", "amplitude", "f0", "a0")), 5).alias("distance"), F.round(F.avg(C.half_tone_ratio("frequency", "f0")), 5).alias("ratio"))


@query("SELECT vec_id, round((2 * e * l / vl - (1 + q) * l * l / vl + q - 1) / (2 * q), 5) AS divergence FROM (SELECT vec_id, embedding[1]::DOUBLE AS e, embedding[2]::DOUBLE AS l, 1 + abs(embedding[4]::DOUBLE) AS vl, (1 + abs(embedding[3]::DOUBLE)) / (1 + abs(embedding[4]::DOUBLE)) AS q FROM embeddings) x")
def c5_divergence_statistic(spark, d):
    e = _e(spark, d).select("vec_id", *[F.element_at("f", k).alias(f"x{k}") for k in range(1, 5)])
    return e.select("vec_id", F.round(C.divergence("x1", "x2", 1 + F.abs("x3"), 1 + F.abs("x4")), 5).alias("divergence"))


PATTERN = [0.2, 0.6, 1.0, 0.6, 0.2]


@query(f"""WITH x AS (SELECT vec_id, k, list_transform(range(1, 6), lambda j: CASE WHEN k + j <= 64 THEN abs(embedding[k + j]::DOUBLE) ELSE 0.0 END) AS s FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS k FROM embeddings) q),
 e AS (SELECT vec_id, k, list_sum(list_transform(range(1, 6), lambda j: abs(s[j] / greatest(list_max(s), 1.1920929e-07) - ({PATTERN})[j]))) / 5 AS dist FROM x)
 SELECT vec_id, round(min(dist), 6) AS distance FROM e GROUP BY 1""")
def f13_a19_pattern_distance(spark, d):
    e = _e(spark, d).select("vec_id", F.transform("f", lambda x: F.abs(x)).alias("f"))
    return e.select("vec_id", F.round(C.pattern_distance("f", PATTERN)["distance"], 6).alias("distance"))


@query(f"WITH {LONG}, r AS (SELECT frame_idx, dim, x, row_number() OVER (PARTITION BY frame_idx ORDER BY x DESC, dim) AS rank FROM long) SELECT 0::BIGINT AS recording_id, frame_idx, dim, rank FROM r WHERE rank <= 5")
def o1_top_peaks(spark, d):
    return K.top_k(long_features(spark, d), ["recording_id", "frame_idx"], "x", "dim", 5).select("recording_id", "frame_idx", "dim", "rank")


@query(f"WITH {SERIES}, r AS (SELECT recording_id, frame_idx, value, row_number() OVER (PARTITION BY recording_id ORDER BY value, frame_idx) AS position FROM series) SELECT recording_id, frame_idx, position FROM r")
def o6_argsort(spark, d):
    w = Window.partitionBy("recording_id").orderBy("value", "frame_idx")
    return series(spark, d).select("recording_id", "frame_idx", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def o9_argmax(spark, d):
    return _e(spark, d).select("vec_id", (F.array_position("f", F.array_max("f")) - 1).alias("best"))


@query(f"WITH {SERIES} SELECT recording_id, frame_idx, trunc(value * 16000 / 256)::BIGINT AS sample, round(frame_idx * 0.016, 6)::DOUBLE AS seconds, round(frame_idx * 8000 / 1023.0, 6)::DOUBLE AS hertz FROM series")
def f17_f18_f19_axes(spark, d):
    """Samples, seconds and frequencies from integer grids."""
    s = series(spark, d)
    return s.select("recording_id", "frame_idx", (F.col("value") * 16000 / 256).cast("long").alias("sample"), F.round(F.col("frame_idx") * 0.016, 6).alias("seconds"), F.round(F.col("frame_idx") * 8000 / 1023.0, 6).alias("hertz"))


@query(f"WITH {LONG}, c AS (SELECT frame_idx, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM long), g AS (SELECT unnest(range(67, 434)) - 1 AS r), p AS (SELECT dim, frame_idx, count(x) OVER o AS n, sum(x) OVER o AS s, sum(x * x) OVER o AS q FROM c WINDOW o AS (PARTITION BY dim ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)), t AS (SELECT dim, max(n) AS n0, arg_max(s, n) AS s0, arg_max(q, n) AS q0 FROM p GROUP BY 1), j AS (SELECT a.frame_idx, a.dim, a.n AS r, n0, q0 / n0 - pow(s0 / n0, 2) AS v0, a.q / a.n - pow(a.s / a.n, 2) AS v1, (q0 - b.q) / (n0 - b.n) - pow((s0 - b.s) / (n0 - b.n), 2) AS v2 FROM p a JOIN p b ON a.dim = b.dim AND b.n = a.n + 1 JOIN t ON t.dim = a.dim WHERE a.n >= 66 AND a.n < n0 - 66) SELECT 0::BIGINT AS recording_id, frame_idx, r, round(max(n0) / 2.0 * sum(ln(v0)) - r / 2.0 * sum(ln(v1)) - (max(n0) - r) / 2.0 * sum(ln(v2)) - 2.0 * 0.5 * (64 + 0.5 * 64 * 65) * ln(max(n0)), 2) AS bic FROM j GROUP BY frame_idx, r")
def b1_delta_bic(spark, d):
    """Gain of every cut of one window."""
    return A.delta_bic(long_features(spark, d), 64, 2.0).select("recording_id", "frame_idx", "r", F.round("bic", 2).alias("bic"))


@query(f"WITH {LONG}, s AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM long GROUP BY 1, 2), p AS (SELECT a.label AS a, b.label AS b, a.n AS n1, b.n AS n2, (a.q + b.q) / (a.n + b.n) - pow((a.s + b.s) / (a.n + b.n), 2) AS v0, a.q / a.n - pow(a.s / a.n, 2) AS v1, b.q / b.n - pow(b.s / b.n, 2) AS v2 FROM s a JOIN s b ON a.dim = b.dim AND a.label < b.label) SELECT 0::BIGINT AS recording_id, a, b, round(sum((n1 + n2) / 2.0 * ln(v0) - n1 / 2.0 * ln(v1) - n2 / 2.0 * ln(v2)) - 0.01 * 0.5 * (64 + 0.5 * 64 * 65) * ln(max(n1 + n2)), 3) AS bic FROM p GROUP BY a, b")
def b5_u2_pair_bic(spark, d):
    """The criterion for merging each pair of groups, from their sums."""
    s = A.group_sums(long_features(spark, d), ["recording_id", "label"])
    return A.pair_bic(s, "label", 64, 0.01).select("recording_id", "a", "b", F.round("bic", 3).alias("bic"))
