"""The table of named plots: which result of which analyzer, with which parameters. Nothing is drawn."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, as users know them: grapher_id, analyzer, result_id, parameters, staging.
GRAPHERS = [
    ("grapher_irit_speech_4hz_segments", "irit_speech_4hz", "irit_speech_4hz.segments", {}, True),
    ("grapher_irit_speech_4hz_segments_median", "irit_speech_4hz", "irit_speech_4hz.segments_median", {}, False),
    ("grapher_irit_speech_entropy_segments", "irit_speech_entropy", "irit_speech_entropy.segments", {}, False),
    ("grapher_irit_music_snb_segments", "irit_music_snb", "irit_music_snb.segments", {}, True),
    ("grapher_irit_music_sln_segments", "irit_music_sln", "irit_music_sln.segments", {}, False),
    ("grapher_irit_tempogram", "irit_tempogram", "irit_tempogram", {}, True),
    ("grapher_irit_startseg", "irit_startseg", "irit_startseg.segments", {}, False),
    ("grapher_irit_singingturns", "irit_singing_turns", "irit_singing_turns", {}, True),
    ("grapher_irit_monopoly_segments", "irit_monopoly", "irit_monopoly.segments", {}, False),
    ("grapher_irit_singing_segments", "irit_singing", "irit_singing.segments", {}, True),
    ("grapher_limsi_sad_etape", "limsi_sad", "limsi_sad.sad_segments", {"sad_model": "etape"}, True),
    ("grapher_limsi_sad_maya", "limsi_sad", "limsi_sad.sad_segments", {"sad_model": "maya"}, True),
    ("grapher_limsi_sad_adaptive", "limsi_sad", "limsi_sad.sad_segments", {"sad_model": "etape", "dews": 0.6, "speech_threshold": 0.5, "adapt": True}, True),
    ("grapher_limsi_diarization_speakers", "limsi_diarization", "limsi_diarization.speakers", {"sad_model": "etape"}, True),
    ("grapher_limsi_diarization_speakers_maya", "limsi_diarization", "limsi_diarization.speakers", {"sad_model": "maya"}, True),
    ("grapher_labri_smn_speech", "labri_speech_music_noise", "labri_speech_music_noise.speech", {}, True),
    ("grapher_labri_smn_music", "labri_speech_music_noise", "labri_speech_music_noise.music", {}, True),
    ("grapher_labri_singing", "labri_singing", "labri_singing", {}, False),
]


def grapher_table(spark: SparkSession) -> DataFrame:
    rows = [(g, a, r, json.dumps(p, sort_keys=True), s) for g, a, r, p, s in GRAPHERS]
    return spark.createDataFrame(rows, "grapher_id string, analyzer string, result_id string, parameters string, staging boolean")


def grapher_sql() -> str:
    rows = ", ".join(f"('{g}', '{a}', '{r}', '{json.dumps(p, sort_keys=True)}', {str(s).lower()})" for g, a, r, p, s in GRAPHERS)
    return f"SELECT * FROM (VALUES {rows}) AS t(grapher_id, analyzer, result_id, parameters, staging)"
