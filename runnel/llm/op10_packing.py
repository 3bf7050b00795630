"""Packing of token sequences by minimum bin slack.

Every document is cut into full windows and one remainder. How many remainders there are of each
length is a histogram of at most ``capacity`` numbers, whatever the input. A subset-sum dynamic
program over bitsets finds the multiset of remaining lengths that fills a window closest to its
capacity; backtracking gives its counts, and it is used as often as the histogram allows. What no
multiset fills exactly is laid end to end and cut at window borders, and the last window is cut
into powers of two, which need no padding.

Tasks number their pieces of each length; those numbers and the histogram's prefix sums tell each
piece its window and offset by arithmetic, so no task ever sees all pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runnel.llm.common import documents, tokenizer, written

CAPACITY = 2048
PIECE = "doc_id long, text_hash long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
#: At most so many cut pieces are looked up by a broadcast of their ids; more by a shuffled join.
FEW = 20_000


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """The multiset of lengths, holding the largest one, whose sum is closest to ``capacity``.

    ``reach[k]`` has bit s set where the first k items sum to s. Longer lengths come first, and
    the search ends as soon as the window is exactly full.
    """
    lengths = sorted(counts, reverse=True)
    first, room = lengths[0], capacity - lengths[0]
    counts = {**counts, first: counts[first] - 1}
    whole, items, reach = (1 << (room + 1)) - 1, [], [1]
    for x in lengths:
        for _ in range(min(counts[x], room // x)):
            now = (reach[-1] | (reach[-1] << x)) & whole
            if now == reach[-1]:
                break
            items.append(x)
            reach.append(now)
            if now >> room & 1:
                break
        if reach[-1] >> room & 1:
            break
    left, chosen = reach[-1].bit_length() - 1, [first]
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> left & 1:
            chosen.append(items[k - 1])
            left -= items[k - 1]
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple], int]:
    """Which piece goes where: (rows, pool, windows used).

    rows: (length, first, last, per, sequence, offset), pieces first to last - 1 of a length go
    ``per`` to a window, from window ``sequence`` and from ``offset`` on.
    pool: (length, first, last, position), pieces laid end to end from ``position`` on.
    """
    left, used = dict(histogram), Counter()
    rows, pool, windows, position = [], [], 0, 0
    while left:
        chosen = Counter(fill(left, capacity))
        times = min(left[x] // n for x, n in chosen.items())
        exact = sum(x * n for x, n in chosen.items()) == capacity
        if not exact:  # nothing fills a window with this length: all its pieces are cut
            x = max(chosen)
            chosen, times = Counter({x: 1}), left[x]
        offset = 0
        for x, n in sorted(chosen.items(), reverse=True):
            if exact:
                rows.append((x, used[x], used[x] + n * times, n, windows, offset))
                offset += x * n
            else:
                pool.append((x, used[x], used[x] + times, position))
                position += x * times
            used[x] += n * times
            left[x] -= n * times
            if not left[x]:
                del left[x]
        windows += times if exact else 0
    return rows, pool, windows


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, part, seen = tokenizer(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()
        names = [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some, rows = batch.slice(lo, 2000), []
                for doc_id, text_hash, ids in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), tok.encode(some.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        rows.append((doc_id, text_hash, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]))
                        seen[length] += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return with_hash(docs).mapInArrow(cut, PIECE)


def with_hash(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def recut(pieces: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The checksum of pieces that a window border has cut, from their documents' texts."""

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                rows = some.to_pydict()
                sums = [zlib.crc32((ids + end)[4 * a : 4 * (a + n)]) for ids, a, n in zip(tok.encode(rows.pop("text")), rows["start"], rows["length"])]
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()) if f.name == "ids_crc32" else some.column(f.name) for f in some.schema if f.name != "text"], [f.name for f in some.schema if f.name != "text"])

    kept = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c != "text")
    return pieces.mapInArrow(checksum, kept)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text, other columns are ignored. A null or empty text is the end id
    alone. Rows that share an id are packed each on its own. An empty table packs to no rows.
    Sequence ids count from 0; only windows cut to powers of two are shorter than ``capacity``.
    """
    spark = docs.sparkSession
    pieces = written(tokenized(docs, vocabulary, end_id, capacity), "pieces")
    parts = pieces.groupBy("length", "part").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))), "parts")
    # at most `capacity` rows reach the driver, and the plan has at most sum(capacity / length) windows' patterns
    histogram = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("count")).collect()}
    rows, pool, windows = plan(histogram, capacity)
    ranked = pieces.join(parts.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")

    def table(data: list[tuple], names: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(data, ", ".join(f"{c} long" for c in names.split())))

    inside = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    k = F.col("rank") - F.col("first")
    exact = ranked.join(table(rows, "p_length first last per sequence at"), inside).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.expr("(rank - first) div per")).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("p_length")).alias("offset"),
    )
    if not pool:
        return exact.select(out)
    total = sum(x * (b - a) for x, a, b, _ in pool)
    tail = total % capacity
    # borders of the last window: its powers of two, longest first
    borders = [total - tail]
    for bit in reversed(range(capacity.bit_length())):
        if tail >> bit & 1:
            borders.append(borders[-1] + (1 << bit))
    laid = ranked.join(table(pool, "p_length first last position"), inside).withColumn("lo", F.col("position") + k * F.col("p_length"))
    laid = laid.withColumn("hi", F.col("lo") + F.col("length"))
    cuts = F.array(*[F.lit(x).cast("long") for x in borders])
    grid = F.expr(f"transform(sequence(lo div {capacity}, (hi - 1) div {capacity}), x -> x * {capacity}L)")
    begins = F.array_sort(F.array_distinct(F.concat(grid, F.filter(cuts, lambda b: b < F.col("hi")))))
    laid = laid.withColumn("b", F.explode(begins))
    after = F.array_min(F.filter(F.concat(cuts, F.array(((F.expr(f"b div {capacity}") + 1) * capacity))), lambda x: x > F.col("b")))
    laid = laid.withColumn("from", F.greatest("lo", "b")).withColumn("to", F.least("hi", after))
    laid = laid.where("to > from")
    small = sum((F.col("b") >= x).cast("long") for x in borders[1:-1]) if len(borders) > 2 else F.lit(0).cast("long")
    laid = laid.select(
        "doc_id", "text_hash", (F.col("start") + F.col("from") - F.col("lo")).alias("start"), (F.col("to") - F.col("from")).alias("length"), "ids_crc32", "doc_tokens",
        (F.lit(windows) + F.expr(f"b div {capacity}") + small).alias("sequence_id"), (F.col("from") - F.col("b")).alias("offset"),
        ((F.col("to") - F.col("from")) < (F.col("hi") - F.col("lo"))).alias("cut"),
    )
    laid = written(laid, "laid")
    keep = laid.where(~F.col("cut")).select(out)
    # a text is looked up by its id and hash, once however often the row repeats
    split, key = laid.where("cut").drop("cut"), ["doc_id", "text_hash"]
    wanted = split.select(*key).distinct()
    if total // capacity + len(borders) <= FEW:
        wanted = F.broadcast(wanted)
    same = F.col("a.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("a.text_hash") == F.col("w.text_hash"))
    texts = with_hash(docs).alias("a").join(wanted.alias("w"), same, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    split = split.alias("a").join(texts.alias("w"), same).select("a.*", "w.text").drop("text_hash")
    return exact.select(out).unionByName(keep).unionByName(recut(split, vocabulary, end_id).select(out))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids; one row per piece."""
    return pack(documents(spark, sf_dir))
