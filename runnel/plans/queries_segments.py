"""Segment algebra and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runnel.operators import segments as S
from runnel.operators.windows import by_frame
from runnel.plans.queries_windows import O, OVER
from runnel.plans.registry import Registry
from runnel.sources.tables import SERIES, series, table

REGISTRY = Registry()
query = REGISTRY.query
SEG = f"""{SERIES}, marked AS (SELECT recording_id, frame_idx, (value > 50)::INT AS label, CASE WHEN lag(value > 50) {O} = (value > 50) THEN 0 ELSE 1 END AS ch FROM series),
 numbered AS (SELECT *, sum(ch) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} - 1 AS seg FROM marked),
 segments AS (SELECT recording_id, seg AS seg_idx, label, min(frame_idx) * 0.25 AS start, (max(frame_idx) - min(frame_idx) + 1) * 0.25 AS duration FROM numbered GROUP BY recording_id, seg, label)"""
OS = "OVER (PARTITION BY recording_id ORDER BY start)"


def merge_sql(source: str, out: str) -> str:
    return f"""{out}_c AS (SELECT *, CASE WHEN lag(label) {OS} = label THEN 0 ELSE 1 END AS mc FROM {source}), {out}_r AS (SELECT *, sum(mc) OVER (PARTITION BY recording_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS mr FROM {out}_c),
 {out} AS (SELECT recording_id, label, min(start) AS start, max(start + duration) - min(start) AS duration FROM {out}_r GROUP BY recording_id, mr, label)"""


def flag_segments(spark, d):
    s = series(spark, d).withColumn("on", (F.col("value") > 50).cast("int"))
    return S.timed(S.runs(s, "on"), 0.25).select("recording_id", "seg_idx", "label", "start", "duration")


OUT = "SELECT recording_id, label::INT AS label, round(start, 6)::DOUBLE AS start, round(duration, 6)::DOUBLE AS duration FROM "


def _out(df):
    return df.select("recording_id", F.col("label").cast("int").alias("label"), F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


@query(f"WITH {SEG}, coarse AS (SELECT recording_id, seg_idx, (label + seg_idx // 3) % 2 AS label, start, duration FROM segments), {merge_sql('coarse', 'm')} {OUT} m")
def g1_g2_merge_adjacent(spark, d):
    s = flag_segments(spark, d).withColumn("label", ((F.col("label") + F.expr("seg_idx div 3")) % 2).cast("int"))
    return _out(S.merge_adjacent(s))


@query(f"""WITH {SEG}, voiced AS (SELECT recording_id, (seg_idx // 4) % 2 AS label, start, duration FROM segments WHERE label = 1),
 c AS (SELECT *, CASE WHEN lag(label) {OS} = label THEN 0 ELSE 1 END AS mc FROM voiced), r AS (SELECT *, sum(mc) OVER (PARTITION BY recording_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS mr FROM c),
 m AS (SELECT recording_id, label, min(start) AS start, arg_max(start + duration, start) - min(start) AS duration FROM r GROUP BY recording_id, mr, label) {OUT} m""")
def g3_merge_speakers(spark, d):
    s = flag_segments(spark, d).where("label = 1").withColumn("label", F.expr("(seg_idx div 4) % 2"))
    return _out(S.merge_speakers(s))


def _flip_sql(to: int) -> str:
    return f"""WITH {SEG}, n AS (SELECT *, row_number() {OS} AS k, count(*) OVER (PARTITION BY recording_id) AS total FROM segments),
 f AS (SELECT recording_id, start, duration, CASE WHEN k > 1 AND k < total AND duration < 0.5 THEN {to} ELSE label END AS label FROM n), {merge_sql('f', 'm')} {OUT} m"""


@query(_flip_sql(1))
def g4_flip_short_speech(spark, d):
    return _out(S.cleaned(flag_segments(spark, d), to=1))


@query(_flip_sql(0))
def g4_flip_short_music(spark, d):
    return _out(S.cleaned(flag_segments(spark, d), to=0))


@query(f"""WITH {SEG}, runs AS (SELECT recording_id, min(frame_idx) AS s0, max(frame_idx) + 1 AS s1 FROM numbered WHERE label = 0 GROUP BY recording_id, seg HAVING count(*) >= 3),
 ends AS (SELECT recording_id, count(*) AS n FROM series GROUP BY 1),
 tiles AS (SELECT recording_id, coalesce(lag(s1) OVER (PARTITION BY recording_id ORDER BY s0), 0) * 0.008 AS start, s0 * 0.008 AS e, 1 AS label FROM runs UNION ALL SELECT recording_id, s0 * 0.008, s1 * 0.008, 0 FROM runs
  UNION ALL SELECT ends.recording_id, coalesce(max(s1), 0) * 0.008, max(n) * 0.008, 1 FROM ends LEFT JOIN runs USING (recording_id) GROUP BY 1)
 SELECT recording_id, label::INT AS label, round(start, 6)::DOUBLE AS start, round(e - start, 6)::DOUBLE AS duration FROM tiles WHERE e > start""")
def g5_session_tiling(spark, d):
    s = series(spark, d).withColumn("on", (F.col("value") > 50).cast("int"))
    quiet = S.runs(s, "on").where("label = 0 and end_idx - start_idx >= 2").select("recording_id", F.col("start_idx").alias("s0"), (F.col("end_idx") + 1).alias("s1"))
    ends = s.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return _out(S.sessions(quiet, ends, 0.008))


@query(f"""WITH {SERIES}, b AS (SELECT recording_id, frame_idx AS t FROM series WHERE label = 'click'), r AS (SELECT recording_id, t AS start, lead(t) OVER w - t AS duration, (row_number() OVER w - 1) % 2 AS label FROM b WINDOW w AS (PARTITION BY recording_id ORDER BY t))
 SELECT recording_id, start::BIGINT AS start, duration::BIGINT AS duration, label::INT AS label FROM r WHERE duration IS NOT NULL""")
def g6_parity_segments(spark, d):
    b = series(spark, d).where("label = 'click'").select("recording_id", F.col("frame_idx").alias("t"))
    return S.alternating(b)


@query(f"""WITH {SERIES}, v AS (SELECT recording_id, frame_idx, label = 'purchase' AS cut FROM series WHERE value > 20), c AS (SELECT *, CASE WHEN cut OR frame_idx - lag(frame_idx) {O} > 1 THEN 1 ELSE 0 END AS nw FROM v),
 r AS (SELECT *, sum(nw) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS chunk FROM c) SELECT recording_id, chunk::BIGINT AS chunk_id, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx, count(*) AS n FROM r GROUP BY recording_id, chunk""")
def g7_chunks(spark, d):
    s = series(spark, d).where("value > 20").withColumn("cut", F.col("label") == "purchase")
    return S.chunks(s, "cut")


@query(f"WITH {SERIES} SELECT recording_id, coalesce(lag(frame_idx) {O}, 0)::BIGINT AS start, frame_idx::BIGINT AS stop FROM series WHERE label = 'click'")
def g8_rupture_intervals(spark, d):
    b = series(spark, d).where("label = 'click'").select("recording_id", F.col("frame_idx").alias("t"))
    return S.ruptures(b)


@query(f"""WITH {SERIES}, p AS (SELECT recording_id, frame_idx, value, lag(value) {O} AS b, lead(frame_idx) {O} IS NULL AS last FROM series),
 c AS (SELECT *, CASE WHEN NOT last AND least(b, value) > 0 AND greatest(b, value) / least(b, value) > pow(2, 1 / 12.0) THEN 1 ELSE 0 END AS nw FROM p)
 SELECT recording_id, frame_idx, sum(nw) {OVER.format('UNBOUNDED PRECEDING', 'CURRENT ROW')}::BIGINT AS note FROM c""")
def g9_note_splitting(spark, d):
    return S.notes(series(spark, d), "value").select("recording_id", "frame_idx", "note")


@query(f"WITH {SEG} SELECT recording_id, 'run' AS origin, label::INT AS label, round(start, 6)::DOUBLE AS start FROM segments WHERE label = 1 UNION ALL SELECT recording_id, 'event', 2, frame_idx * 0.25 FROM series WHERE label = 'click'")
def u1_segment_union(spark, d):
    a = flag_segments(spark, d).where("label = 1").select("recording_id", F.lit("run").alias("origin"), F.col("label").cast("int").alias("label"), F.round("start", 6).alias("start"))
    b = series(spark, d).where("label = 'click'").select("recording_id", F.lit("event").alias("origin"), F.lit(2).alias("label"), (F.col("frame_idx") * 0.25).alias("start"))
    return a.unionByName(b)


@query(f"WITH {SERIES} SELECT DISTINCT recording_id, label FROM series")
def a21_u3_distinct_labels(spark, d):
    return series(spark, d).select("recording_id", "label").distinct()


@query(f"WITH {SERIES} SELECT recording_id, frame_idx FROM series a WHERE label = 'view' AND NOT EXISTS (SELECT 1 FROM series b WHERE b.recording_id = a.recording_id AND b.label = 'click' AND b.frame_idx = a.frame_idx + 1)")
def j13_u4_remove_used(spark, d):
    s = series(spark, d)
    used = s.where("label = 'click'").select("recording_id", (F.col("frame_idx") - 1).alias("frame_idx"))
    return s.where("label = 'view'").select("recording_id", "frame_idx").join(used, ["recording_id", "frame_idx"], "left_anti")


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM c) SELECT conv_id AS recording_id, seg::BIGINT AS seg_idx, role AS label, min(turn) AS start_idx, max(turn) AS end_idx FROM r GROUP BY conv_id, seg, role""")
def w12_role_runs(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("frame_idx"), "role")
    return S.runs(c, "role")


@query(f"""WITH {SERIES}, e AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY recording_id ORDER BY t, frame_idx) > 3600 * 24 THEN 1 ELSE 0 END AS nw FROM series),
 r AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY t, frame_idx ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT recording_id, k::BIGINT AS session, count(*) AS n, round(max(t) - min(t), 3)::DOUBLE AS seconds FROM r GROUP BY recording_id, k""")
def t9_gap_sessions(spark, d):
    w = Window.partitionBy("recording_id").orderBy("t", "frame_idx")
    s = series(spark, d).withColumn("nw", F.when(F.col("t") - F.lag("t").over(w) > 3600 * 24, 1).otherwise(0))
    s = s.withColumn("session", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("recording_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))
