"""The analyzers: recipes from blocks of samples to framewise scores, events and segments.

An analyzer takes mono blocks (see ``sources.audio``) and returns DataFrames by result id. Parents
are results of other analyzers, drawn once per run. ``run`` resolves them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runnel.functions import columns as C
from runnel.functions import signal as G
from runnel.operators import bic, changepoints, harmonic
from runnel.operators import joins as J
from runnel.operators import models as M
from runnel.operators import segments as S
from runnel.operators import topk as K
from runnel.operators import windows as W
from runnel.sources.audio import frames


@dataclass
class Context:
    """A recording set with its rate, the user's models, and results so far."""

    blocks: DataFrame
    rate: int
    gmm: DataFrame | None = None
    prototypes: list[list[float]] = field(default_factory=list)
    onsets: DataFrame | None = None
    done: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    #: with which parameters the results in ``done`` were asked for
    asked: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Analyzer:
    """What an analyzer is called, needs and takes."""

    id: str
    function: Callable
    parents: tuple[str, ...] = ()
    rate: int | None = None
    parameters: dict = field(default_factory=dict)


#: By id; analyzer and result ids are fixed values that users know.
REGISTRY: dict[str, Analyzer] = {}


def analyzer(id: str, parents: tuple[str, ...] = (), rate: int | None = None, **parameters) -> Callable:
    def add(f: Callable) -> Callable:
        REGISTRY[id] = Analyzer(id, f, parents, rate, parameters)
        return f

    return add


#: Fixed values of parameters that are choices, those a parent takes from its child, and those that can be None.
CHOICES, SHARED, OPTIONAL = {"sad_model": ("etape", "maya")}, ("sad_model",), ("dllh_min", "dllh_max")


def checked(id: str, options: dict) -> Analyzer:
    """The analyzer of this id; unknown or mistyped parameters and values that are no choice raise."""
    a = REGISTRY[id]
    for name, value in options.items():
        if name not in a.parameters:
            raise ValueError(f"{id} has no parameter {name}")
        default = a.parameters[name]
        if name in CHOICES and value not in CHOICES[name]:
            raise ValueError(f"{name} of {id} must be one of {CHOICES[name]}")
        if value is None and name in OPTIONAL:
            continue
        if default is not None and not isinstance(value, (int, float) if isinstance(default, float) else type(default)):
            raise ValueError(f"{name} of {id} must be like {default!r}")
    return a


def run(id: str, ctx: Context, **options) -> dict[str, DataFrame]:
    """The results of an analyzer by id, its parameters checked; parents run first, each once, with
    the values of parameters in SHARED."""
    a = checked(id, options)
    if a.rate and ctx.rate != a.rate:
        raise ValueError(f"{id} needs {a.rate} samples a second, not {ctx.rate}")
    for p in a.parents:
        told = {k: v for k, v in options.items() if k in SHARED and k in REGISTRY[p].parameters}
        if p not in ctx.done or ctx.asked.get(p, {}) != told:
            ctx.done[p], ctx.asked[p] = run(p, ctx, **told), told
    return a.function(ctx, **{**a.parameters, **options})


def matrix(ctx: Context, size: int, step: int, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """recording_id, frame_idx, f: a numpy function over batches of frames."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"recording_id": pdf.recording_id, "frame_idx": pdf.frame_idx, "f": list(function(np.stack(pdf.samples.to_numpy())))})

    return frames(ctx.blocks, size, step).mapInPandas(apply, "recording_id string, frame_idx long, f array<double>")


def plan_features(ctx: Context, plans: list[str]) -> DataFrame:
    """recording_id, frame_idx, f: feature plans over whole recordings, side by side; a recording is one task."""
    rate = ctx.rate

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.asarray(s, float) for s in pdf.sort_values("block_idx").samples])
        parts = [G.run_plan(p, x, rate) for p in plans]
        n = min(map(len, parts))
        f = np.hstack([p[:n] for p in parts])
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "frame_idx": np.arange(n), "f": list(f)})

    return ctx.blocks.groupBy("recording_id").applyInPandas(apply, "recording_id string, frame_idx long, f array<double>")


def _names(df: DataFrame, off: str, on: str) -> DataFrame:
    return df.withColumn("label", F.col("label").cast("int")).withColumn("label_name", F.when(F.col("label") == 1, on).otherwise(off))


@analyzer("irit_speech_4hz", medfilt_duration=5.0)
def speech_4hz(ctx: Context, medfilt_duration: float) -> dict[str, DataFrame]:
    size, step = int(0.016 * ctx.rate), int(0.008 * ctx.rate)
    bank = G.mel_filter_bank(30, 2048, ctx.rate).T
    weights = G.band_weights(G.band_pass(100, 3.5 / ctx.rate, 4.5 / ctx.rate), 30)
    e = matrix(ctx, size, step, lambda x: G.spectrum(x, 4096) @ bank).select("recording_id", "frame_idx", C.dot("f", weights.tolist()).alias("value"))
    whole = Window.partitionBy("recording_id")
    mean = F.avg("value").over(whole)
    e = e.withColumn("value", F.when(F.max(F.abs("value")).over(whole) > 0, F.col("value") / F.nullif(mean, F.lit(0.0))).otherwise(F.col("value")))
    m = W.modulation(e, int(2.0 * ctx.rate / step)).withColumn("on0", F.coalesce(F.col("modulation") > 2.0, F.lit(False)))
    n = int(np.ceil(medfilt_duration * ctx.rate / step))
    t = step / ctx.rate
    return {
        "irit_speech_4hz.energy_confidence": m.select("recording_id", "frame_idx", (F.col("frame_idx") * t).alias("t"), C.confidence("modulation", 2.0).alias("value")),
        "irit_speech_4hz.segments": _names(S.timed(S.runs(m, "on0"), t), "NonSpeech", "Speech"),
        "irit_speech_4hz.segments_median": _names(S.timed(S.runs(W.majority(m, "on0", n + 1 - n % 2), "median"), t), "NonSpeech", "Speech"),
    }


@analyzer("irit_speech_entropy", blocksize=1024)
def speech_entropy(ctx: Context, blocksize: int) -> dict[str, DataFrame]:
    def entropy(x: np.ndarray) -> np.ndarray:
        out = []
        for row in x:
            c, edges = np.histogram(row, 10)
            c = c[c > 0]
            out.append([-(c * np.log(c)).sum() / len(row) + np.log(len(row)) + np.log(edges[1] - edges[0]) + 1])
        return np.array(out)

    e = matrix(ctx, blocksize, blocksize, entropy).select("recording_id", "frame_idx", F.col("f")[0].alias("value"))
    m = W.modulation(e, int(2 * ctx.rate / blocksize), log=False).withColumn("on0", F.coalesce(F.col("modulation") > 0.4, F.lit(False)))
    t = blocksize / ctx.rate
    opened = S.without_short_runs(m, "on0", 10, "opened")
    return {
        "irit_speech_entropy.confidence": m.select("recording_id", "frame_idx", (F.col("frame_idx") * t).alias("t"), C.confidence("modulation", 0.4).alias("value")),
        "irit_speech_entropy.segments": _names(S.timed(S.runs(opened, "opened"), t), "NonSpeech", "Speech"),
    }


def _samples(ctx: Context) -> DataFrame:
    return ctx.blocks.select("recording_id", F.col("block_idx").alias("frame_idx"), F.col("samples").alias("value"))


@analyzer("irit_diverg")
def diverg(ctx: Context) -> dict[str, DataFrame]:
    return {"irit_diverg.segments": changepoints.cut_recordings(_samples(ctx), ctx.rate, "segment")}


@analyzer("irit_diverg2")
def diverg2(ctx: Context) -> dict[str, DataFrame]:
    pcm = _samples(ctx).withColumn("value", F.transform("value", lambda x: C.int16(x).cast("double")))
    return {"irit_diverg2.segments": changepoints.cut_recordings(pcm, ctx.rate, "hybrid")}


def _boundaries(ctx: Context) -> DataFrame:
    return ctx.done["irit_diverg2"]["irit_diverg2.segments"].select("recording_id", "t")


def _grid(b: DataFrame, lo: float, step: float) -> DataFrame:
    ends = b.groupBy("recording_id").agg(F.max("t").alias("e"))
    n = F.ceil((F.col("e") - 2 * lo) / step - 1e-9).cast("long")
    return ends.where(n > 0).select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")).select("recording_id", (F.col("k") * step + lo).alias("t"))


def _music(ctx: Context, name: str, grid: DataFrame, score: Callable) -> dict[str, DataFrame]:
    c = J.range_count(grid, _boundaries(ctx), 0.5)
    o = Window.partitionBy("recording_id").orderBy("t")
    s = score(c).withColumn("frame_idx", (F.row_number().over(o) - 1).cast("long"))
    r = S.runs(s, "on0")
    at = s.select("recording_id", F.col("frame_idx").alias("_i"), F.col("t").alias("_t"))
    r = r.join(at.withColumnsRenamed({"_i": "start_idx", "_t": "start"}), ["recording_id", "start_idx"]).join(at.withColumnsRenamed({"_i": "end_idx", "_t": "_e"}), ["recording_id", "end_idx"])
    return {f"{name}.energy_confidence": s.select("recording_id", "frame_idx", "t", "value", "confidence"), f"{name}.segments": _names(r.withColumn("duration", F.col("_e") - F.col("start")).drop("_e"), "NonMusic", "Music")}


@analyzer("irit_music_snb", ("irit_diverg2",))
def music_snb(ctx: Context) -> dict[str, DataFrame]:
    conf = C.many_segments_confidence(F.col("n").cast("double"), 20.0)
    return _music(ctx, "irit_music_snb", _grid(_boundaries(ctx), 0.0, 0.1), lambda c: c.withColumn("value", F.col("n").cast("double")).withColumn("confidence", conf).withColumn("on0", F.col("confidence") > 0))


@analyzer("irit_music_sln", ("irit_diverg2",))
def music_sln(ctx: Context) -> dict[str, DataFrame]:
    conf = C.long_segments_confidence(F.col("value"), 0.05)
    # 1 / (n + 1) > 0.05 in whole numbers
    return _music(ctx, "irit_music_sln", _grid(_boundaries(ctx), 0.5, 0.1), lambda c: c.withColumn("value", 1.0 / (F.col("n") + 1)).withColumn("confidence", conf).withColumn("on0", F.col("n") <= 18))


@analyzer("irit_tempogram", ("irit_diverg2",))
def tempogram(ctx: Context) -> dict[str, DataFrame]:
    rate, size = ctx.rate, int(0.1 * ctx.rate)

    def weights(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"recording_id": [], "t": [], "weight": []})
        x = np.abs(np.concatenate([np.asarray(s, float) for s in b.sort_values("block_idx").samples]))
        c = np.concatenate(([0.0], np.cumsum(x)))
        at = (a.t.to_numpy() * rate).astype(int)
        lo, hi = np.maximum(at - size, 0), np.minimum(at + size, len(x))
        at = np.minimum(at, len(x))
        return pd.DataFrame({"recording_id": a.recording_id, "t": a.t, "weight": (c[hi] - c[at]) - (c[at] - c[lo])})

    b = _boundaries(ctx).groupBy("recording_id").cogroup(ctx.blocks.groupBy("recording_id")).applyInPandas(weights, "recording_id string, t double, weight double")
    near = J.range_pairs(_grid(_boundaries(ctx), 0.0, 0.5), b, 5.0)
    freqs = F.expr("transform(sequence(0, 511), k -> 0.1D + k * 4.9D / 511)")
    pairs = near.groupBy("recording_id", "t").agg(F.collect_list(F.struct("b_t", "weight")).alias("b"))
    wave = lambda f, fun: F.aggregate("b", F.lit(0.0), lambda a, p: a + F.coalesce(p["weight"] * fun(2 * F.pi() * f * (p["b_t"] - F.col("t"))), F.lit(0.0)))
    power = F.transform(freqs, lambda f: F.sqrt(F.pow(wave(f, F.cos), 2) + F.pow(wave(f, F.sin), 2)))
    return {"irit_tempogram": pairs.select("recording_id", "t", power.alias("value"), F.transform(freqs, lambda f: f * 60).alias("y_value"))}


@analyzer("irit_startseg", threshold=0.004, max_distance=0.12)
def startseg(ctx: Context, threshold: float, max_distance: float) -> dict[str, DataFrame]:
    if not ctx.prototypes:
        raise ValueError("irit_startseg needs prototypes of a silence's energy")
    rate, size, step = ctx.rate, int(0.020 * ctx.rate), int(0.008 * ctx.rate)
    taps = G.band_pass(10, 100 / rate, 0.2)

    def energy(pdf: pd.DataFrame) -> pd.DataFrame:
        x, state, out = np.concatenate([np.asarray(s, float) for s in pdf.sort_values("block_idx").samples]), None, []
        for f in G.frames_of(x, size, step):  # the filter's memory goes from frame to frame, overlaps and all
            y, state = G.fir(taps, f, state)
            out.append(np.sqrt((y**2).mean()))
        return pd.DataFrame({"recording_id": pdf.recording_id.iloc[0], "frame_idx": np.arange(len(out)), "value": np.array(out, float)})

    e = ctx.blocks.groupBy("recording_id").applyInPandas(energy, "recording_id string, frame_idx long, value double")
    e = e.withColumn("value", F.when(F.lead("frame_idx").over(W.by_frame()).isNull(), 0.0).otherwise(F.col("value")))
    e = e.withColumn("value", F.coalesce(F.col("value") / F.nullif(F.max("value").over(W.whole()), F.lit(0.0)), F.col("value"))).withColumn("quiet", F.col("value") < threshold)
    length = max(map(len, ctx.prototypes))
    q = W.opening(W.closing(e, "quiet", length, "closed"), "closed", length, "silent")
    runs = S.runs(q.withColumn("silent", F.coalesce("silent", F.lit(False))), "silent").where("label")
    spans = runs.select("recording_id", F.col("start_idx").alias("start"), F.col("end_idx").alias("stop"), "start_idx", "end_idx")
    met = J.points_in_intervals(q.select("recording_id", "frame_idx", "value"), spans, "frame_idx")
    shapes = met.groupBy("recording_id", "start_idx", "end_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))), lambda x: x["value"]).alias("f"))
    near = F.least(*[C.pattern_distance("f", p)["distance"] for p in ctx.prototypes], F.lit(float("inf")))
    silences = shapes.where(near < max_distance).select("recording_id", F.col("start_idx").alias("s0"), (F.col("end_idx") + 1).alias("s1"))
    ends = e.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return {"irit_startseg.segments": S.sessions(silences, ends, step / rate).withColumn("label_name", F.when(F.col("label") == 0, "Start").otherwise("Session"))}


@analyzer("irit_singing_turns", threshold=0.0)
def singing_turns(ctx: Context, threshold: float) -> dict[str, DataFrame]:
    size, step = int(0.020 * ctx.rate), int(0.010 * ctx.rate)
    bank = G.mel_filter_bank(12, 512, ctx.rate).T
    f = matrix(ctx, size, step, lambda x: np.log(np.maximum(G.spectrum(x, 1024) @ bank, 1e-12)))
    votes = bic.vote(f)
    n = f.select("recording_id", "frame_idx")
    d = n.join(votes, ["recording_id", "frame_idx"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    cuts = K.per_recording(d, "density", K.suppressed, "decision", 5).where(F.col("decision") > threshold).select("recording_id", "frame_idx")
    ends = n.groupBy("recording_id").agg(F.max("frame_idx").alias("frame_idx"))
    at = cuts.union(ends).union(ends.select("recording_id", F.lit(0).cast("long"))).distinct()
    turns = S.alternating(at, "frame_idx").withColumn("stop", F.col("start") + F.col("duration"))
    rows = J.points_in_intervals(f, turns.select("recording_id", "start", F.col("stop"), F.col("start").alias("seg")), "frame_idx", 256.0).where("frame_idx < stop")
    owner = bic.cluster_segments(rows.select("recording_id", "seg", "frame_idx", "f"), "seg", float(2.805))
    out = turns.join(owner.withColumnRenamed("seg", "start"), ["recording_id", "start"])
    return {"irit_singing_turns": out.select("recording_id", (F.col("start") * 0.01).alias("start"), (F.col("duration") * 0.01).alias("duration"), F.col("cluster").cast("int").alias("label"))}


@analyzer("irit_harmo_tracking")
def harmo_tracking(ctx: Context) -> dict[str, DataFrame]:
    size, step, rate = int(0.032 * ctx.rate), int(0.016 * ctx.rate), ctx.rate
    s = matrix(ctx, size, step, lambda x: G.spectrum(x, 2048, power=False)).select("recording_id", "frame_idx", F.posexplode("f").alias("bin", "amplitude"))
    o = Window.partitionBy("recording_id", "frame_idx").orderBy("bin")
    peaks = s.withColumn("_b", F.lag("amplitude").over(o)).withColumn("_a", F.lead("amplitude").over(o)).where("amplitude > _b and amplitude > _a")
    top = K.top_k(peaks, ["recording_id", "frame_idx"], "amplitude", "bin", 5).withColumn("frequency", F.col("bin") * (rate / 2) / 1023)
    nodes = harmonic.track(top.select("recording_id", "frame_idx", "rank", "frequency", "amplitude"))
    return {"irit_harmo_tracking": nodes.withColumn("t", (F.col("frame_idx") + 1) * 0.016)}


@analyzer("irit_harmo_cluster", ("irit_harmo_tracking",))
def harmo_cluster(ctx: Context) -> dict[str, DataFrame]:
    nodes = ctx.done["irit_harmo_tracking"]["irit_harmo_tracking"]
    comp = harmonic.components(J.linked(nodes)).withColumnRenamed("node", "track_id")
    return {"irit_harmo_cluster": harmonic.group_tracks(nodes.join(comp, ["recording_id", "track_id"]))}


@analyzer("irit_monopoly")
def monopoly(ctx: Context) -> dict[str, DataFrame]:
    size, rate = int(0.020 * ctx.rate), ctx.rate
    p = matrix(ctx, size, size, lambda x: np.array([G.pitch(f, rate, 60.0, rate / 2, 0.3) for f in x]))
    p = p.select("recording_id", "frame_idx", F.col("f")[0].alias("confidence"), F.col("f")[1].alias("f0"))
    m = M.monophony(p, "confidence")
    at = m.withColumn("start", F.col("block_idx") * 0.5).withColumn("duration", F.lit(0.5))
    pitch = p.withColumn("_l", F.lead("frame_idx").over(W.by_frame())).where("_l is not null").select("recording_id", "frame_idx", ((F.col("frame_idx") + 0.5) * 0.02).alias("t"), "f0", "confidence")
    return {"irit_monopoly.pitch": pitch, "irit_monopoly.segments": _names(S.merge_adjacent(at.select("recording_id", "start", "duration", "label")), "Poly", "Mono")}


def _vibrato(pdf_rows: DataFrame, keys: list[str], value: str, rate: float) -> DataFrame:
    """keys, n, vibrato: the vibrato decision of each group of ordered values."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("frame_idx")[value].to_numpy()
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(x), G.has_vibrato(x, rate)]], columns=[*keys, "n", "vibrato"])

    kinds = dict(pdf_rows.dtypes)
    return pdf_rows.groupBy(*keys).applyInPandas(decide, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, vibrato boolean")


def extended_vibrato(nodes: DataFrame, least: int = 3) -> DataFrame:
    """recording_id, start, stop (frames), ratio: share of the partials' frames with vibrato between ruptures."""
    ext = nodes.groupBy("recording_id", "track_id").agg(F.array(F.min("frame_idx"), F.max("frame_idx")).alias("e"))
    cuts = ext.select("recording_id", F.explode("e").alias("t")).groupBy("recording_id", "t").count().where(F.col("count") >= least)
    pieces = J.points_in_intervals(nodes.select("recording_id", "track_id", "frame_idx", "frequency"), S.ruptures(cuts), "frame_idx", 64.0)
    v = _vibrato(pieces, ["recording_id", "start", "stop", "track_id"], "frequency", 1 / 0.016)
    return v.groupBy("recording_id", "start", "stop").agg((F.sum(F.when(F.col("vibrato"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))


@analyzer("irit_singing", ("irit_monopoly", "irit_harmo_tracking"))
def singing(ctx: Context) -> dict[str, DataFrame]:
    segs = ctx.done["irit_monopoly"]["irit_monopoly.segments"].withColumn("stop", F.col("start") + F.col("duration"))
    pitch = ctx.done["irit_monopoly"]["irit_monopoly.pitch"]
    mono = segs.where("label = 1").select("recording_id", "start", "stop")
    met = J.points_in_intervals(pitch.select("recording_id", "frame_idx", "t", "f0"), mono, "t", 4.0)
    smooth = W.median_of(met, "f0", 5, "smooth")
    v = _vibrato(S.notes(smooth, "smooth"), ["recording_id", "start", "stop", "note"], "smooth", 50.0)
    a = v.groupBy("recording_id", "start", "stop").agg((F.sum(F.when(F.col("vibrato"), F.col("n") * 0.02).otherwise(0.0)) / (F.col("stop") - F.col("start"))).alias("ratio"))
    a = a.select("recording_id", "start", "stop", (F.col("ratio") >= 0.1).cast("int").alias("label"), F.lit("mono").alias("origin"))
    b = extended_vibrato(ctx.done["irit_harmo_tracking"]["irit_harmo_tracking"]).select("recording_id", (F.col("start") * 0.016).alias("start"), (F.col("stop") * 0.016).alias("stop"), (F.col("ratio") >= 0.15).cast("int").alias("label"))
    # each rupture interval once, cut to the polyphonic segments
    p = segs.where("label = 0").select("recording_id", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    b = b.join(p, "recording_id").where("start < _b and stop > _a").select("recording_id", F.greatest("start", "_a").alias("start"), F.least("stop", "_b").alias("stop"), "label", F.lit("poly").alias("origin"))
    return {"irit_singing.segments": _names(a.unionByName(b).withColumn("duration", F.col("stop") - F.col("start")).drop("stop"), "NonSinging", "Singing")}


SAD_PLANS = [
    "mfcc: MFCC CepsIgnoreFirstCoeff=0 blockSize=1024 stepSize=256",
    "mfccd1: MFCC CepsIgnoreFirstCoeff=0 blockSize=1024 stepSize=256 > Derivate DOrder=1",
    "mfccd2: MFCC CepsIgnoreFirstCoeff=0 blockSize=1024 stepSize=256 > Derivate DOrder=2",
    "zcr: ZCR blockSize=1024 stepSize=256",
]
SMN_PLANS = [p for d in ("", " > Derivate DOrder=1", " > Derivate DOrder=2") for p in (f"m: MFCC CepsNbCoeffs=12 MelNbFilters=22 MelMinFreq=20 MelMaxFreq=5000 blockSize=480 stepSize=160{d}", f"e: Energy blockSize=480 stepSize=160{d}")]


def _models(ctx: Context, id: str) -> DataFrame:
    if ctx.gmm is None:
        raise ValueError(f"{id} needs a table of mixtures")
    return ctx.gmm


def _of_model(models: DataFrame, name: str) -> DataFrame:
    """The mixtures called ``name.`` and something, by that; all of them where none is."""
    own = models.where(F.startswith("model_id", F.lit(f"{name}.")))
    return models if own.isEmpty() else own.withColumn("model_id", F.substring("model_id", len(name) + 2, 1000))


@analyzer("limsi_sad", rate=16000, sad_model="etape", yes="speech", no="nonspeech", dews=0.2, speech_threshold=1.0, dllh_min=-10.0, dllh_max=10.0, adapt=False, exclude=0.01, keep=0.2)
def sad(ctx: Context, sad_model: str, yes: str, no: str, dews: float, speech_threshold: float, dllh_min: float | None, dllh_max: float | None, adapt: bool, exclude: float, keep: float) -> dict[str, DataFrame]:
    """The ratio is bounded only where both bounds are given."""
    f = plan_features(ctx, SAD_PLANS)
    llr = M.log_ratio(M.log_likelihood(f, _of_model(_models(ctx, "limsi_sad"), sad_model)), yes, no)
    if adapt:
        w = int(dews * ctx.rate / 256)
        sides = W.rank_slices(W.smooth(llr, "llr", w, "s"), "s", exclude, keep).select("recording_id", "frame_idx", "side")
        long = f.select("recording_id", "frame_idx", F.posexplode("f").alias("dim", "x"))
        trained = long.join(sides, ["recording_id", "frame_idx"]).groupBy("recording_id", "side", "dim").agg(F.avg("x").alias("mu"), F.var_pop("x").alias("var"))
        llr = M.gaussian_ratio(long, trained, ["recording_id", "frame_idx"])
    if dllh_min is not None and dllh_max is not None:
        llr = llr.withColumn("llr", C.clip("llr", dllh_min, dllh_max))
    d = W.dilate_erode(llr, "llr", int(dews * ctx.rate / 256), "deed").withColumn("on0", F.col("deed") > speech_threshold)
    t = 256 / ctx.rate
    frame = lambda c: d.select("recording_id", "frame_idx", (F.col("frame_idx") * t).alias("t"), F.col(c).alias("value"))
    return {"limsi_sad.sad_lhh_diff": frame("llr"), "limsi_sad.sad_de_lhh_diff": frame("deed"), "limsi_sad.sad_segments": _names(S.timed(S.runs(d, "on0"), t), "Not Speech", "Speech")}


@analyzer("limsi_diarization", ("limsi_sad",), rate=16000, sad_model="etape", gdiff_win_size_sec=5.0, min_seg_size_sec=2.5, bic_penalty_coeff=0.5, recentre=False)
def diarization(ctx: Context, sad_model: str, gdiff_win_size_sec: float, min_seg_size_sec: float, bic_penalty_coeff: float, recentre: bool) -> dict[str, DataFrame]:
    t = 256 / ctx.rate
    w, least = int(gdiff_win_size_sec / t), int(min_seg_size_sec / t)
    llr = ctx.done["limsi_sad"]["limsi_sad.sad_lhh_diff"]
    f = plan_features(ctx, SAD_PLANS[:1]).join(llr.where("value > 0").select("recording_id", "frame_idx"), ["recording_id", "frame_idx"])
    f = f.withColumn("n", (F.row_number().over(W.by_frame()) - 1).cast("long"))
    long = f.select("recording_id", F.col("n").alias("frame_idx"), F.posexplode("f").alias("dim", "x"))
    g = W.two_sided_divergence(long, w).withColumn("frame_idx", F.col("frame_idx") - (0 if recentre else w))
    cut = K.per_recording(g, "divergence", K.recursive_cuts, "cut", least).where("cut = 1").select("recording_id", F.col("frame_idx").alias("n"), F.lit(True).alias("cut"))
    x = f.join(cut, ["recording_id", "n"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    o = W.by_frame()
    new = F.when(F.col("cut") | (F.col("frame_idx") - F.lag("frame_idx").over(o) > 1), 1).otherwise(0)
    x = x.withColumn("_n", new).withColumn("chunk_id", F.sum("_n").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    owner = bic.cluster_segments(x.select("recording_id", "chunk_id", "frame_idx", "f"), "chunk_id", bic_penalty_coeff, full=True)
    chunks = x.groupBy("recording_id", "chunk_id").agg((F.min("frame_idx") * t).alias("start"), ((F.max("frame_idx") - F.min("frame_idx") + 1) * t).alias("duration"))
    out = chunks.join(owner, ["recording_id", "chunk_id"]).withColumn("label", F.col("cluster").cast("int"))
    return {"limsi_diarization.speakers": S.merge_speakers(out.select("recording_id", "start", "duration", "label"))}


@analyzer("labri_speech_music_noise", rate=16000, penalty=50.0)
def speech_music_noise(ctx: Context, penalty: float) -> dict[str, DataFrame]:
    gmm = _models(ctx, "labri_speech_music_noise")
    llh = M.log_likelihood(plan_features(ctx, SMN_PLANS), gmm)
    names = sorted(r[0] for r in gmm.select("model_id").distinct().collect())
    path = M.viterbi(llh, names, penalty)
    out = {}
    for kind, to in (("speech", 1), ("music", 0)):
        s = path.select("recording_id", (F.col("start_idx") / 100).alias("start"), (F.col("n") / 100).alias("duration"), F.contains("model_id", F.lit(kind)).cast("int").alias("label"))
        out[f"labri_speech_music_noise.{kind}"] = _names(S.cleaned(s, 0.5, to), f"Non{kind.title()}", kind.title())
    return out


@analyzer("labri_singing", rate=16000, yes="sing", no="nosing")
def labri_singing(ctx: Context, yes: str, no: str) -> dict[str, DataFrame]:
    if ctx.onsets is None:
        raise ValueError("labri_singing needs a table of onsets")
    llr = M.log_ratio(M.log_likelihood(plan_features(ctx, SMN_PLANS), _models(ctx, "labri_singing")), yes, no)
    on = ctx.onsets.select("recording_id", F.round(F.col("t") * 100).cast("long").alias("onset_idx"))
    first = llr.select("recording_id").distinct().withColumn("onset_idx", F.lit(0).cast("long"))
    met = J.since_last(llr.select("recording_id", "frame_idx", "llr"), on.union(first))
    s = met.groupBy("recording_id", "onset_idx").agg((F.sum("llr") > 0).cast("int").alias("label"), F.count(F.lit(1)).alias("n"))
    s = s.select("recording_id", (F.col("onset_idx") / 100).alias("start"), (F.col("n") / 100).alias("duration"), "label")
    return {"labri_singing": _names(S.cleaned(s, 0.5, 1), "NonSinging", "Singing")}


