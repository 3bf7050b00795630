"""Relative Lempel-Ziv parsing of documents against all documents with smaller ids.

The reference holds every window of ``width`` words once, at its first place: in the document with
the least id, as early as it stands there. It is indexed in blocks (the hash partitions of a
shuffle) by 96 bits of each window's hash, and every document is looked up in all blocks. As a window has one
place in the reference, so has every longer run: the longest factor from a word on is as far as
the document's windows follow each other in the reference. A document is factored greedily from
its first word, each factor beginning where the last one ended; what no window covers is literal.
Factors cannot be shorter than ``width``, so all are long enough to be duplicate spans. At their
boundaries the windows that begin inside a factor and end behind it are checked too, for a passage
that two factors share would otherwise keep its end.

To keep the index small, each window names an anchor: the least hash among its short word runs.
Equal windows name equal anchors, so only windows whose anchor two different texts have can match;
the others are never indexed. Texts equal as a whole are settled before that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import WordSequence, discard_table, documents, written

#: Words of an anchor's run.
SHORT = 16
#: Windows with more than one in SHARE of all rows, and than LEAST, are dealt to several tasks; the
#: list of them, at most SHARE rows, is broadcast.
SHARE, LEAST = 65_536, 1_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive numbers, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(words: WordSequence, width: int) -> np.ndarray:
    """The anchor of every window."""
    short = min(SHORT, width)
    if words.n < width:
        return np.zeros(0, np.uint64)
    return least_of(words.runs(short), width - short + 1)


def parsed(docs: DataFrame, width: int) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, rows = batch.slice(lo, 500), []
                for text in part.column(1).to_pylist():
                    words = text.split() if text else []
                    joined = b" ".join(words)
                    sha = hashlib.sha256(joined)
                    found = np.unique(anchors(WordSequence(words), width)) if len(words) >= width else ()
                    rows.append((len(words), sha.hexdigest(), found))
                ends = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
                flat = np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in rows if len(r[2]))]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "n_words", "sha", "anchors"])

    return docs.mapInArrow(parse, "doc_id long, n_words long, sha string, anchors array<long>")


def windows(docs: DataFrame, width: int) -> DataFrame:
    """(h, g, doc_id, at, lead): the windows whose anchor is in the row's ``shared``, by two hashes;
    lead is the first place of an equal window in the same text."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, out = batch.slice(lo, 200), []
                shared = part.column(2)
                for k, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    words = WordSequence(text.split())
                    at = np.flatnonzero(np.isin(anchors(words, width), shared[k].values.to_numpy().view(np.uint64)))
                    h, half = words.runs(width)[at], words.runs(width // 2)
                    g = (half[at] * np.uint64(3) + half[at + width - width // 2]) >> np.uint64(33)
                    _, first, which = np.unique(h, return_index=True, return_inverse=True)
                    out.append((h.view(np.int64), g.astype(np.int32), np.full(len(at), doc_id, np.int64), at.astype(np.int32), at[first][which].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "g", "doc_id", "at", "lead"])

    return docs.mapInArrow(index, "h long, g int, doc_id long, at int, lead int")


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """(first word, number of words, source, first word there) of the greedy parse, and of the
    runs at factor boundaries that cover words outside the factors.

    at: the windows found, ascending; source and place: where each stands in the reference.
    """
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(place) != 1)) + 1
    out, across, end = [], [], 0
    for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)]):
        first, last = int(at[a]), int(at[b - 1])
        if last < end:  # every window begins inside the last factor
            if last + width > end:
                across.append((first, last - first + width, int(source[a]), int(place[a])))
            continue
        begin = max(first, end)
        if begin > end:  # where the next factor begins at once, it covers what lies across
            out += across
        out.append((begin, last - begin + width, int(source[a]), int(place[a]) + begin - first))
        across, end = [], last + width
    return sorted(out + across)


def removed(docs: DataFrame, width: int) -> DataFrame:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, rows = batch.slice(lo, 200), []
                for k, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    words = text.split()
                    at, source, place = (part.column(c)[k].values.to_numpy() for c in (2, 3, 4))
                    order = np.lexsort((source, at))
                    # rows that share an id may be of different lengths
                    spans = [(x, min(n, len(words) - x), *rest) for x, n, *rest in factors(at[order], source[order], place[order], width) if x < len(words)]
                    keep = np.ones(len(words), bool)
                    for x, n, *_ in spans:
                        keep[x : x + n] = False
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                    rows.append((doc_id, hashlib.sha256(b" ".join(words)).hexdigest(), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("first", "n", "source", "place"), x)) for x in spans]))
                kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), kind))], ["id", "own_sha", "gone", "rest", "spans"])

    return docs.mapInArrow(take, "id long, own_sha string, gone long, rest string, spans array<struct<first: int, n: int, source: long, place: int>>")


def duplicate_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``width`` words around it also starts in a document with a smaller
    id. spans lists the factors (first word, number of words, source, first word there), and the
    runs across their boundaries, in order; a copy of a whole document is one factor. Null texts have no words. Rows with a null id neither lose words nor count as
    sources. Of rows that share an id and differ in text, each is judged on the union of the
    windows found for that id, and a place is one of theirs. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    table = written(parsed(texts, width), "parsed")
    heads = table.where(f"doc_id is not null and n_words >= {width}").groupBy("sha").agg(F.min("doc_id").alias("head"))
    heads = written(heads, "heads")
    marks = table.join(heads, [table.sha == heads.sha, table.doc_id == heads["head"]], "left_semi").select("doc_id", F.explode("anchors").alias("anchor")).distinct()
    shared = marks.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor")
    near = marks.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    near = written(near, "anchors")
    found = written(windows(texts.join(near, "doc_id").where("text is not null"), width), "windows")
    first = found.groupBy("h", "g").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("lead", "doc_id").alias("place"), F.count("*").alias("n")).where("source < last").drop("last")
    first = written(first, "reference")
    # at most SHARE windows can each be more than one in SHARE of all rows: their rows are dealt to several tasks
    much = max(LEAST, (first.agg(F.sum("n")).first()[0] or 0) // SHARE)
    dealt = first.where(F.col("n") > much).select("h", "g", F.expr(f"n div {much} + 1").alias("parts"))
    rows = found.join(F.broadcast(dealt), ["h", "g"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.coalesce("parts", F.lit(1).cast("long"))))
    places = first.select("h", "g", "source", "place", F.explode(F.expr(f"sequence(0L, if(n > {much}, n div {much}, 0L))")).alias("salt"))
    hits = rows.join(places, ["h", "g", "salt"]).where("source < doc_id").groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("at", "source", "place")])
    hits = written(hits, "hits")
    for done in (near, found, first):
        discard_table(done)
    cut = removed(texts.join(hits, "doc_id").where("text is not null"), width).dropDuplicates(["id", "own_sha"])
    whole = table.join(heads, "sha", "left").join(cut, (F.col("doc_id") == F.col("id")) & (F.col("sha") == F.col("own_sha")), "left")
    copy = F.coalesce(F.col("head") < F.col("doc_id"), F.lit(False))
    n = F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long")))
    one = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("n"), F.col("head").alias("source"), F.lit(0).alias("place")))
    return whole.select("doc_id", "n_words", n.alias("n_removed"), F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"), F.when(copy, one).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<first: int, n: int, source: bigint, place: int>>)"))).alias("spans"))


def op8_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words; digests of what is kept."""
    return duplicate_spans(documents(spark, sf_dir), 50).drop("spans")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50) q),
 f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS source FROM g),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f WHERE source < doc_id),
 word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM w),
 kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
