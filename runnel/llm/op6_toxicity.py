"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon, nearness of second-person words to its hits, capitals,
punctuation and obfuscated words. The lexicon holds a few common insults and what the labels teach:
words, and beginnings of words, that toxic texts have far more often than others. Lexicon and trees
are learned from bounded samples of labelled rows (LEXICON_ROWS of each kind, TREE_ROWS), taken in
the order of a hash of the id, so they cost the same at any size; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import documents, held_out, written
from runnel.llm.features import described, isotonic, label_table

#: Bounds of the samples.
LEXICON_ROWS, TREE_ROWS = 4_000, 40_000
#: A learned term is in so many toxic sample texts at least, and its log odds are this high.
LEAST_TEXTS, LEAST_ODDS, TERMS = 3, 2.5, 500
BASE = "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting garbage filth vermin".split()
SECOND = set("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tus vosotros".split())
PREFIXES = (5, 7)

NAMES = ["log_words", "hits", "hit_share", "odds", "best", "kinds", "prefix_hits", "prefix_odds", "prefix_best", "base_hits", "near_second", "second", "upper", "bangs", "questions", "marks", "obfuscated"]

_PLAIN = str.maketrans(dict.fromkeys(".,;:!?\"()[]", " "))
_MIXED = re.compile(r"[^\W\d_][\d@$*!|_.-]+[^\W\d_]")
_LEET = str.maketrans("013457@$!|", "oieastasii")


def terms_of(text: str) -> set[str]:
    """Words and marked beginnings of words."""
    words = set(text.lower().translate(_PLAIN).split())
    return words.union(*({w[:k] + "~" for w in words if len(w) >= k} for k in PREFIXES))


class Features:
    """The vector of a text under a lexicon: term -> log odds."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {t: o for t, o in lexicon.items() if not t.endswith("~")}
        self.prefixes = {t[:-1]: o for t, o in lexicon.items() if t.endswith("~")}
        self.base = set(BASE)

    def __call__(self, data: bytes | None) -> list[float]:
        text = data.decode("utf-8", "replace") if data else ""
        words = text.lower().translate(_PLAIN).split()
        if not words:
            return [0.0] * len(NAMES)
        n, distinct = len(words), set(words)
        bent = {}
        for w in _MIXED.findall(text)[:1] and {w for w in text.lower().split() if _MIXED.search(w)}:
            plain = re.sub(r"[^\w]|_|\d", "", w.translate(_LEET))
            if plain in self.words or plain in self.base:
                bent[w] = plain
        found = {w: self.words.get(w, 3.0) for w in distinct if w in self.words or w in self.base}
        begun = {}
        for k in PREFIXES:
            begun |= {w: max(self.prefixes[w[:k]], begun.get(w, 0.0)) for w in distinct if w[:k] in self.prefixes and len(w) >= k}
        times = {w: words.count(w) for w in {*found, *begun}} if found or begun else {}
        hits = sum(times[w] for w in found) + len(bent)
        near = 0
        if found or begun:
            seconds = np.array([-10**6, *(k for k, w in enumerate(words) if w in SECOND), 10**9])
            at = np.array([k for k, w in enumerate(words) if w in found or w in begun])
            p = np.searchsorted(seconds, at)
            near = int((np.minimum(seconds[p] - at, at - seconds[p - 1]) <= 5).sum())
        upper = sum(map(str.isupper, text))
        return [
            np.log(n), hits, hits / n, sum(found[w] * times[w] for w in found) / n, max(found.values(), default=0.0), len(found), sum(times[w] for w in begun), sum(begun[w] * times[w] for w in begun) / n,
            max(begun.values(), default=0.0), sum(times[w] for w in found if w in self.base) + len(bent), near, sum(words.count(w) for w in SECOND & distinct) / n,
            upper / len(text), text.count("!") / n, text.count("?") / n, (text.count(",") + text.count(".")) / n, len(bent) / n,
        ]


def learned_lexicon(docs: DataFrame, known: DataFrame) -> dict[str, float]:
    """Terms of toxic texts and their smoothed log odds, from at most LEXICON_ROWS texts of each kind."""
    order = F.xxhash64("doc_id")
    some = known.where("y = 1").orderBy(order).limit(LEXICON_ROWS).union(known.where("y = 0").orderBy(order).limit(LEXICON_ROWS))
    sizes = dict(some.groupBy("y").count().collect())

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.float64())], ["term", "y"])

    # a bounded number of small rows: at most 2 * LEXICON_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(some), "doc_id").select("text", "y")
    counts = texts.mapInArrow(terms, "term string, y double").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= LEAST_TEXTS)
    n1, n0 = sizes.get(1.0, 0) + 1.0, sizes.get(0.0, 0) + 1.0
    odds = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    top = counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy((F.col("odds") * F.sqrt("a")).desc(), "term").limit(TERMS).collect()
    return {r["term"]: r["odds"] for r in top}


class Trees:
    """Boosted regression trees for log loss over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins)[:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                feature, cut = np.zeros(1 << level, np.int64), np.full(1 << level, self.bins + 1)
                width, best = self.bins + 1, np.full(1 << level, 1e-6)
                for k in range(b.shape[1]):
                    at = node * width + b[:, k]
                    sg, sh, sn = (np.bincount(at, w, minlength=width << level).reshape(-1, width).cumsum(1) for w in (g, h, np.ones(len(y))))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sn < self.least) | (tn - sn < self.least)] = 0
                    c = gain.argmax(1)
                    better = gain[np.arange(len(c)), c] > best
                    best = np.where(better, gain[np.arange(len(c)), c], best)
                    feature, cut = np.where(better, k, feature), np.where(better, c, cut)
                splits.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaves = self.rate * np.bincount(node, g, minlength=1 << self.depth) / (np.bincount(node, h, minlength=1 << self.depth) + 1)
            self.trees.append((splits, leaves))
            f += leaves[node]
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.start)
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            f += leaves[node]
        return f


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    labels: (doc_id, y) to learn from. Null and empty texts have all features 0 and get the score
    of that point. Without labels of both kinds every score is the share of 1 (0 where there are
    none). A null id is never learned from and not held out. Other columns are ignored.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = written(labels.join(ids, "doc_id", "left_semi"), "labels")
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, n):
        done = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("score", F.lit(ones / n if n else 0.0))
    else:
        table = written(described(docs, Features(learned_lexicon(docs, known)), NAMES), "features")
        sample = known.orderBy(F.xxhash64("doc_id", F.lit(1))).limit(TREE_ROWS)
        rows = table.join(F.broadcast(sample), "doc_id").select("doc_id", "x", "y").orderBy("doc_id", "x").limit(TREE_ROWS).toArrow()
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(NAMES))
        y, fold = rows.column("y").to_numpy(), rows.column("doc_id").to_numpy() * 2654435761 % 2**32 % 3
        margins = np.zeros(len(y))
        for k in range(3):  # each third is scored by trees that have not seen it
            if 0 < y[fold != k].sum() < (fold != k).sum():
                margins[fold == k] = Trees().fit(x[fold != k], y[fold != k])(x[fold == k])
        curve = isotonic([(round(float(m), 2), 1.0, float(v)) for m, v in zip(margins, y)])
        trees = Trees().fit(x, y)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.interp(trees(v), *curve), 0, 1) if len(v) else np.zeros(0))], ["doc_id", "score"])

        done = table.mapInArrow(score, "doc_id long, score double")
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored as ``labels.toxic`` marks them."""
    return toxicity_scores(documents(spark, sf_dir), label_table(spark, sf_dir, "toxic"))
