"""Signal kernels over the suppliers' signals, and the same sums written out in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runnel.functions import signal as G
from runnel.operators import models as M
from runnel.plans.queries_models import LLK, gmm
from runnel.plans.queries_python import signal
from runnel.plans.registry import Registry
from runnel.sources.tables import features

REGISTRY = Registry()
query = REGISTRY.query

#: Samples a second of the signals; frames of SIZE samples do not overlap.
RATE, SIZE = 1000, 64
SIGNAL = "s AS (SELECT l_suppkey AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS k, l_extendedprice / 60000 - 0.5 AS x FROM lineitem)"
#: Windowed frames and their spectrum without the last bin.
SPECTRUM = f"""{SIGNAL}, n AS (SELECT recording_id, count(*) AS n FROM s GROUP BY 1),
 w AS (SELECT recording_id, k // {SIZE} AS frame_idx, k % {SIZE} AS j, x * (0.54 - 0.46 * cos(2 * pi() * (k % {SIZE}) / {SIZE - 1})) AS x FROM s JOIN n USING (recording_id) WHERE k < n // {SIZE} * {SIZE}),
 b AS (SELECT unnest(range({SIZE // 2})) AS bin),
 spec AS (SELECT recording_id, frame_idx, bin, pow(sum(x * cos(2 * pi() * j * bin / {SIZE})), 2) + pow(sum(x * sin(2 * pi() * j * bin / {SIZE})), 2) AS p FROM w, b GROUP BY ALL)"""


def per_signal(spark, d, function, columns: str) -> DataFrame:
    """Rows of ``function`` (a data frame of a recording's samples, in order), a recording to a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf.sort_values("frame_idx").value.to_numpy())
        return out.assign(recording_id=pdf.recording_id.iloc[0])[["recording_id", *out.columns]]

    return signal(spark, d).groupBy("recording_id").applyInPandas(run, f"recording_id long, {columns}")


def _table(m: np.ndarray, row: str, column: str, value: str) -> pd.DataFrame:
    i, j = np.indices(m.shape)
    return pd.DataFrame({row: i.ravel(), column: j.ravel(), value: np.round(m.ravel(), 6)})


@query(f"WITH {SPECTRUM} SELECT recording_id, frame_idx, bin, round(p, 6) AS power FROM spec")
def f4_spectrum(spark, d):
    return per_signal(spark, d, lambda x: _table(G.spectrum(G.frames_of(x, SIZE, SIZE), SIZE), "frame_idx", "bin", "power"), "frame_idx long, bin long, power double")


#: Filter f has its corners at bins lo and hi; it rises over the first half of them.
_MEL = f"""WITH {SPECTRUM}, e AS (SELECT i, round(700 * (pow(10, i * 2595 * log10(1 + {RATE / 2} / 700) / 7 / 2595) - 1) / {RATE / 2} * {SIZE // 2 - 1})::BIGINT AS at FROM (SELECT unnest(range(8)) AS i) q),
 c AS (SELECT a.i AS f, a.at AS lo, greatest(a.at + 1, z.at) + 1 - a.at AS n FROM e a JOIN e z ON z.i = a.i + 2),
 bank AS (SELECT f, lo + j AS bin, CASE WHEN j < n // 2 THEN CASE WHEN n // 2 = 1 THEN 0.0 ELSE j / (n // 2 - 1) END WHEN n - n // 2 = 1 THEN 1.0 ELSE 1 - (j - n // 2) / (n - n // 2 - 1) END::DOUBLE AS v FROM (SELECT *, unnest(range(n)) AS j FROM c) q)
 SELECT recording_id, frame_idx, f AS band, round(sum(p * v), 6) AS energy FROM spec JOIN bank USING (bin) GROUP BY ALL"""


@query(_MEL)
def f1_f2_mel_energies(spark, d):
    """Six triangular filters over the power spectrum."""
    bank = G.mel_filter_bank(6, SIZE // 2, RATE)
    return per_signal(spark, d, lambda x: _table(G.spectrum(G.frames_of(x, SIZE, SIZE), SIZE) @ bank.T, "frame_idx", "band", "energy"), "frame_idx long, band long, energy double")


_FIR = f"""WITH {SIGNAL}, t AS (SELECT i, i - 64 AS m, 0.54 - 0.46 * cos(2 * pi() * i / 128) AS w FROM (SELECT unnest(range(129)) AS i) q),
 g AS (SELECT i, m, w * CASE WHEN m = 0 THEN 0.5 - 0.02 ELSE (sin(pi() * 0.5 * m) - sin(pi() * 0.02 * m)) / (pi() * m) END AS h FROM t),
 h AS (SELECT i, h / (SELECT sum(h * cos(pi() * m * 0.26)) FROM g) AS h FROM g)
 SELECT recording_id, s.k + i AS frame_idx, round(sum(h * x), 6) AS value FROM s, h WHERE s.k + i < (SELECT count(*) FROM s AS z WHERE z.recording_id = s.recording_id) GROUP BY ALL"""


@query(_FIR)
def f6_w16_w17_carried_band_pass(spark, d):
    """A band-pass of 129 taps in blocks of 100 samples, each of which takes over the last inputs."""

    def run(x: np.ndarray) -> pd.DataFrame:
        h, state, out = G.band_pass(129, 0.02, 0.5), None, []
        for lo in range(0, len(x), 100):
            y, state = G.fir(h, x[lo : lo + 100], state)
            out.append(y)
        return pd.DataFrame({"frame_idx": np.arange(len(x)), "value": np.round(np.concatenate(out), 6)})

    return per_signal(spark, d, run, "frame_idx long, value double")


#: Lags 0 to 49 over the first 206 samples of frames of 256 every 128.
_YIN = f"""WITH {SIGNAL}, f AS (SELECT recording_id, k // 128 AS frame_idx, k AS head FROM s z WHERE k % 128 = 0 AND k + 256 <= (SELECT count(*) FROM s WHERE s.recording_id = z.recording_id)),
 a AS (SELECT f.recording_id, frame_idx, k - head AS j, x FROM f JOIN s ON s.recording_id = f.recording_id AND k BETWEEN head AND head + 255),
 l AS (SELECT unnest(range(1, 50)) AS lag),
 d AS (SELECT a.recording_id, a.frame_idx, lag, sum((b.x - a.x) * (b.x - a.x)) AS d FROM a CROSS JOIN l JOIN a b ON b.recording_id = a.recording_id AND b.frame_idx = a.frame_idx AND b.j = a.j + lag WHERE a.j < 206 GROUP BY ALL),
 c AS (SELECT *, d * lag / sum(d) OVER (PARTITION BY recording_id, frame_idx ORDER BY lag) AS c FROM d),
 p AS (SELECT *, lead(c) OVER (PARTITION BY recording_id, frame_idx ORDER BY lag) AS after, min(lag) FILTER (WHERE lag >= 5 AND c < 0.9) OVER (PARTITION BY recording_id, frame_idx) AS below FROM c)
 SELECT recording_id, frame_idx, round(least(1.0, min(c) FILTER (WHERE lag BETWEEN 2 AND 48)), 6) AS confidence, coalesce(round(1000.0 / min(lag) FILTER (WHERE lag >= below AND (after IS NULL OR after >= c)), 6), 0.0)::DOUBLE AS f0 FROM p GROUP BY ALL"""


@query(_YIN)
def f9_f10_f11_pitch(spark, d):
    def run(x: np.ndarray) -> pd.DataFrame:
        found = [G.pitch(f, RATE, 20.0, 200.0, 0.9) for f in G.frames_of(x, 256, 128)]
        return pd.DataFrame({"frame_idx": np.arange(len(found)), "confidence": [round(c, 6) for c, _ in found], "f0": [round(f, 6) for _, f in found]})

    return per_signal(spark, d, run, "frame_idx long, confidence double, f0 double")


_VIBRATO = f"""WITH {SIGNAL}, g AS (SELECT recording_id, k, lead(x) OVER (PARTITION BY recording_id ORDER BY k) - x AS x, count(*) OVER (PARTITION BY recording_id) AS n FROM s),
 m AS (SELECT recording_id, bin, sqrt(pow(sum(x * cos(2 * pi() * k * bin / 100)), 2) + pow(sum(x * sin(2 * pi() * k * bin / 100)), 2)) AS a FROM g, (SELECT unnest(range(50)) AS bin) q WHERE k < least(100, n - 2) GROUP BY ALL)
 SELECT recording_id, first(bin ORDER BY a DESC, bin) * 20 / 100.0 BETWEEN 4 AND 8 AS vibrato FROM m GROUP BY 1"""


@query(_VIBRATO)
def f12_vibrato(spark, d):
    """At 20 values a second."""
    return per_signal(spark, d, lambda x: pd.DataFrame({"vibrato": [G.has_vibrato(x, 20.0)]}), "vibrato boolean")


_CEPSTRA = f"""WITH {SPECTRUM}, e AS (SELECT i, 700 * (exp((m0 + i * (m1 - m0) / 9) / 1127) - 1) AS hz FROM (SELECT unnest(range(10)) AS i, 1127 * ln(1 + 20 / 700.0) AS m0, 1127 * ln(1 + 400 / 700.0) AS m1) q),
 bank AS (SELECT a.i AS f, bin, greatest(0, least((hz - a.hz) / (m.hz - a.hz), (z.hz - b.hz) / (z.hz - m.hz))) AS v FROM e a JOIN e m ON m.i = a.i + 1 JOIN e z ON z.i = a.i + 2, (SELECT bin, bin * {RATE} / {SIZE}.0 AS hz FROM b) b),
 l AS (SELECT recording_id, frame_idx, f, ln(greatest(sum(sqrt(p) * v), 1e-10)) AS x FROM spec JOIN bank USING (bin) GROUP BY ALL)
 SELECT recording_id, frame_idx, k - 1 AS coefficient, round(sum(x * sqrt(2 / 8.0) * cos(pi() * k * (f + 0.5) / 8)), 6) AS value FROM l, (SELECT unnest(range(1, 6)) AS k) q GROUP BY ALL""".replace("(hz - a.hz)", "(b.hz - a.hz)")


@query(_CEPSTRA)
def f22_f26_s3_feature_plan(spark, d):
    """Cepstra by a plan in words, over each signal."""
    plan = f"m: MFCC CepsNbCoeffs=5 MelNbFilters=8 MelMinFreq=20 MelMaxFreq=400 blockSize={SIZE} stepSize={SIZE}"
    return per_signal(spark, d, lambda x: _table(G.run_plan(plan, x, RATE), "frame_idx", "coefficient", "value"), "frame_idx long, coefficient long, value double")


@query(f"WITH {LLK} SELECT 0::BIGINT AS recording_id, frame_idx, model_id::BIGINT AS model_id, round(llh, 4) AS llh FROM llh")
def s5_m1_matrix_llh(spark, d):
    """Mixtures read from a table into matrices; they are few and small."""
    rows = gmm(spark, d).orderBy("model_id", "k").collect()
    models = [(m, *(np.array([r[c] for r in rows if r.model_id == m], float) for c in ("weight", "mu", "var"))) for m in sorted({r.model_id for r in rows})]
    return M.matrix_log_likelihood(features(spark, d), models).withColumn("llh", F.round("llh", 4))
