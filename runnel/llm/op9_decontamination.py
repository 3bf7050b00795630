"""Benchmark decontamination on templates.

Numbers, names and units become typed placeholders, so a question with other numbers or names has
the same template. Adjoining number or name words are one slot, and a capital that begins a sentence
or a line is read both as a name and as a word. Windows of WINDOW template words of the benchmark
are a table, by hash, with the values of their slots; the documents' windows are hash-joined with
it. A bitmap of BITS bits (of that size whatever the benchmark) keeps windows that can meet nothing
out of the join. The windows of one item that follow each other in a document, on one diagonal or
on neighbouring ones, make a match. Along it, every slot's value in the item must always stand for
the same value in the document and the other way round; where slots contradict each other, only
the windows that copy the item word by word count.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import KEPT, documents, fresh_worker, mix, written

#: Words of a window; a match needs so large a share of the item's windows, or so many of them.
WINDOW, SHARE, MANY = 8, 0.5, 20
#: Bits of the map of benchmark hashes, as a power of two; benchmark windows that are broadcast at most
#: (some 100 bytes each), more are joined by a shuffle.
BITS, BROADCAST_ROWS = 26, 200_000
#: Bytes of text that are read at once.
PART = 1 << 21

_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:st|nd|rd|th|s|%)?")
_NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
_UNITS = "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec min h hr hours minutes seconds days weeks months years meters metres kilometers grams kilograms liters litres miles feet inches pounds dollars euros cents percent mph kmh kph".split()
#: Words that begin sentences and are no part of a name.
_COMMON = set("""a an the if when while where how what which who whose why each every all some in on at by for from to of and or but so then there this that these those he she it they we you i his her its their our my your is are was were do does did has have had can could will would after before during suppose assume given find let
der die das ein eine wenn wie was wer er sie es wir ihr und oder aber in im auf für von zu nach le la les un une si quand comment il elle on nous vous ils et ou mais dans pour de du des el los las una cuando como qué ella y o pero en para""".split()) - {"will"}
_TRIM = ".,;:!?\"'()[]{}«»„“”"
NUM, NAME, UNIT = "\x02n", "\x02p", "\x02u"


def placeholder(word: str, starts: bool) -> str:
    """The template word of a word; starts: it begins a sentence, where a capital says nothing."""
    core = word.strip(_TRIM)
    low = core.lower()
    if _NUMBER.fullmatch(core) or all(w in _NUMBER_WORDS for w in low.split("-")):
        return NUM
    if low in _UNITS:
        return UNIT
    if not starts and core[:1].isupper() and not core.isupper():
        return NAME
    return low


def code(kind: str) -> int:
    return xxhash.xxh3_64_intdigest(kind.encode("utf-8", "replace")) or 1


_NAME_CODE, _NUM_CODE, _UNIT_CODE = code(NAME), code(NUM), code(UNIT)
_GAP, _STOP, _TRAIL, _LEAD, _USUAL, _NEXT = 1, 2, 4, 8, 16, 32
#: word -> its code inside a sentence, its code at the start of one, and flags.
_WORDS: dict[str, bytes] = {}
KEPT.append(_WORDS)
#: Stand for a line break and for the border of two texts.
_BREAK, _TEXT = "\x03", "\x04"
_PLAIN = frozenset(_NUMBER_WORDS) | frozenset(_UNITS) | _COMMON
_pack = struct.Struct("<3Q").pack


def _known(w: str) -> bytes:
    if w.isalpha() and w.islower() and w not in _PLAIN:
        one = code(w)
        return _pack(one, one, 0)
    core = w.strip(_TRIM)
    low = core.lower()
    if w in (_BREAK, _TEXT) or not core:
        inside = start = 0
    else:
        told = low if core.isalpha() and low not in _PLAIN else placeholder(core, True)
        inside = start = code(told)
        if told == low and core[0].isupper() and not core.isupper():
            inside = _NAME_CODE
    flags = _GAP * (w in (_BREAK, _TEXT)) + _NEXT * (w == _TEXT) + _USUAL * (low in _COMMON)
    if len(core) < len(w):
        flags += _STOP * (w[-1] in ".!?:") + _TRAIL * (w[-1] in _TRIM) + _LEAD * (w[0] in _TRIM)
    return _pack(inside, start, flags)


class Reading:
    """The template words of several texts, one after the other: codes, and maybe[k] where a word
    can be a name as well.

    at[k] is the first of the words (those of punctuation alone left out) that template word k
    stands for, text[k] the text it is in. Arrow splits the texts, so that Python sees distinct words
    only, each once per worker.
    """

    def __init__(self, texts: list[str | None]):
        joined = f" {_TEXT} ".join([(t or "").replace(_TEXT, " ").replace("\n", f" {_BREAK} ") for t in texts])
        words = pc.utf8_split_whitespace(pa.array([joined.strip()], pa.large_string())).flatten().dictionary_encode()
        self._told, words = words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy()
        told = self._told.tolist()
        if told == [""]:  # no word at all
            told, words = [], words[:0]
        if len(_WORDS) > 400_000:
            _WORDS.clear()
        for w in told:
            if w not in _WORDS:
                _WORDS[w] = _known(w)
        known = np.frombuffer(b"".join(map(_WORDS.__getitem__, told)), "<u8").reshape(-1, 3)
        codes, starts, flags = known[:, 0][words], known[:, 1][words], known[:, 2].astype(np.uint8)[words]
        place = np.arange(len(words), dtype=np.int32)
        gap, text = flags & _GAP != 0, np.cumsum(flags & _NEXT != 0, dtype=np.int32)
        # the last word before each one that is no break, and how many breaks lie between
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(gap, -1, place))[:-1])) if len(words) else place
        kept = np.flatnonzero(codes)
        inside, start, last, text, own = codes[kept], starts[kept], last[kept], text[kept], flags[kept]
        breaks, other = kept - 1 - last, np.concatenate(([True], text[1:] != text[:-1]))[: len(kept)]
        hard = other | (last < 0) | (breaks > 1) | (flags[last] & _STOP != 0) if len(words) else gap[kept]
        capital, common = inside == _NAME_CODE, own & _USUAL != 0
        begins = hard | (breaks > 0)
        # adjoining words of one slot
        after = np.zeros(len(kept), bool)
        if len(kept) > 1:
            near = ~other[1:] & (last[1:] == kept[:-1]) & (own[:-1] & _TRAIL == 0) & (own[1:] & _LEAD == 0) & (breaks[1:] < 2)
            number, named = inside == _NUM_CODE, capital & ~(begins & common)
            after[1:] = near & ((number[1:] & number[:-1]) | (named[1:] & named[:-1] & ~hard[1:]))
        first = np.flatnonzero(~after)
        run = np.diff(np.append(first, len(kept))) > 1
        begins, capital = begins[first], capital[first]
        self.at, self.n, self.text = first, len(kept), text[first]
        self.codes = np.where(begins & ~(run & capital), start[first], inside[first])
        self.maybe = begins & capital & ~common[first] & ~run
        self.begin = np.searchsorted(self.text, np.arange(len(texts)))  # each text's first template word
        self._words, self._kept = words, kept

    def value(self, k: int) -> str:
        """What template word k stands for after a letter for its kind: n, u, p (name), m (maybe a
        name); empty for other words."""
        kind = {_NUM_CODE: "n", _UNIT_CODE: "u", _NAME_CODE: "p"}.get(int(self.codes[k]), "m" if self.maybe[k] else "")
        end = self.at[k + 1] if k + 1 < len(self.at) else self.n
        return kind and kind + " ".join(self._told[w].strip(_TRIM) for w in self._words[self._kept[self.at[k] : end]].tolist())

    def first_word(self, k: int, text: int) -> int:
        """The word of the text at which template word k begins (or the text ends)."""
        at = self.at[k] if k < len(self.at) else self.n
        return int(at - self.at[self.begin[text]])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window inside a text, in all readings of its words that may be names."""
        codes, maybe, n = self.codes, self.maybe, len(self.codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * _STEP + codes[k : k + n]
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        h = h[at]
        power = 1
        for k in range(size - 1, -1, -1):
            some = np.flatnonzero(maybe[at + k])
            if len(some):
                more = h[some] + (np.uint64(_NAME_CODE) - codes[at[some] + k]) * np.uint64(power)
                at, h = np.concatenate((at, at[some])), np.concatenate((h, more))
            power = power * int(_STEP) % 2**64
        return at, mix(h)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def template(text: str | None) -> list[str]:
    """The kinds and values of a text's slots, empty for other template words."""
    read = Reading([text])
    return [read.value(k) for k in range(len(read.codes))]


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """h, item_id, item_hash, k, size, item_windows, own (values of its slots): a row per reading of each window."""
    schema = "h long, item_id long, item_hash long, k int, size int, item_windows int, own array<string>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(_WORDS)
        for batch in batches:
            rows = []
            for item, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                read = Reading([text])
                n = len(read.codes)
                size, told = min(window, n), [read.value(k) for k in range(n)]
                if n:
                    at, h = read.windows(size)
                    rows += [(x, item, key, k, size, n - size + 1, told[k : k + size]) for k, x in zip(at.tolist(), h.view(np.int64).tolist())]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text")
    return items.distinct().mapInArrow(cut, schema)


def bitmap(table: DataFrame) -> np.ndarray:
    """A bit for each value of the hashes' first BITS bits: at most 2 ** (BITS - 6) rows reach the driver."""
    word = F.shiftrightunsigned("h", 64 - BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 AS int))")
    out = np.zeros(1 << (BITS - 6), np.int64)
    found = table.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """h, doc_id, text_hash, i, first_word, end_word, told (values of its slots): the windows whose
    hash is in the map; i counts template words from the text's start."""
    schema = "h long, doc_id long, text_hash long, i int, first_word int, end_word int, told array<string>"
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(_WORDS)
        bits = sent.value.view(np.uint64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            # rows with about PART bytes of text together
            sums = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(sums // PART)) + 1).tolist(), len(sums)]
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                ids, keys, texts = (c.to_pylist() for c in part.columns)
                read, rows = Reading(texts), []
                for size in sizes:
                    at, h = read.windows(size)
                    there = bits[(h >> np.uint64(64 - BITS + 6)).astype(np.int64)] >> (h >> np.uint64(64 - BITS) & np.uint64(63)) & np.uint64(1)
                    for k in np.flatnonzero(there).tolist():
                        i, t = int(at[k]), int(read.text[at[k]])
                        rows.append((int(h[k].view(np.int64)), ids[t], keys[t], i - int(read.begin[t]), read.first_word(i, t), read.first_word(i + size, t), [read.value(j) for j in range(i, i + size)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(search, schema)


def accepted(windows: dict[tuple[int, int], tuple], size: int, total: int) -> tuple | None:
    """(first word, words, windows found, slots changed) of the best match of an item of ``total`` windows.

    windows: (item's place, document's place) -> (first word, end word, item's values, document's values).
    """
    best = None
    for way in ways(set(windows), size):
        row = judged(way, windows, size, total)
        if row is None:  # slots contradict each other: what is copied word by word
            row = judged([w for w in way if windows[w][2] == windows[w][3]], windows, size, total)
        if row and (best is None or row[2] > best[2]):
            best = row
    return best


def judged(way: list[tuple[int, int]], windows: dict, size: int, total: int) -> tuple | None:
    """The match of windows that follow each other; () if it is too short, None if its slots contradict each other."""
    bridged, pairs = 0, {}
    for n, (k, i) in enumerate(way):
        _, _, own, told = windows[k, i]
        pairs.update(((k + j, i + j), (own[j], told[j])) for j in range(size))
        if n:
            k0, i0 = way[n - 1]
            if k - k0 <= size + 1 and i - i0 <= 2 * size:
                bridged += k - k0 - 1  # the windows that one word added, left out or replaced spoils
    there, back, changed, slots = {}, {}, 0, 0
    for a, b in pairs.values():
        if not a or not b or (a[0] == "m" and b[0] == "m" and a == b):
            continue
        kind = a[0] if a[0] == b[0] else "p"
        if there.setdefault((kind, a[1:]), b[1:]) != b[1:] or back.setdefault((kind, b[1:]), a[1:]) != a[1:]:
            return None
        slots += 1
        changed += a[1:] != b[1:]
    # with other values in its slots a match must rest on words: placeholders alone are in any text
    if not way or changed and 2 * slots > len({k for k, _ in pairs}) or len(way) + bridged < SHARE * total and len(way) < MANY:
        return ()
    first = windows[way[0]][0]
    return first, windows[way[-1]][1] - first, len(way), changed


def ways(found: set[tuple[int, int]], window: int) -> Iterator[list[tuple[int, int]]]:
    """The windows of every diagonal, and the longest rising sequence of each group of neighbouring ones."""
    lines = defaultdict(list)
    for k, i in sorted(found):
        lines[i - k].append((k, i))
    yield from lines.values()
    group: list[int] = []
    for d in [*sorted(lines), None]:
        if group and (d is None or d - group[-1] > window):
            if len(group) > 1:
                yield rising(sorted((x for g in group for x in lines[g]), key=lambda x: (x[0], -x[1])))
            group = []
        group.append(d)


def rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence that rises in both; points come by rising first and falling second."""
    tails, last, before = [], [], []
    for n, (_, i) in enumerate(points):
        p = bisect.bisect_left(tails, i)
        before.append(last[p - 1] if p else -1)
        if p == len(tails):
            tails.append(i)
            last.append(n)
        else:
            tails[p], last[p] = i, n
    out, n = [], last[-1]
    while n >= 0:
        out.append(points[n])
        n = before[n]
    return out[::-1]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document and item it holds: doc_id, text_hash, item_id, first_word, n_words,
    n_windows, item_windows, slots_changed.

    A document holds an item if half of the item's windows, or MANY, are found on one diagonal or
    in order on neighbouring ones, with consistent slots; windows that one changed word between two
    found ones spoils count for the half. Where slots contradict each other, windows copied word by
    word count alone. Where slot values differ, at least half of the matched words must be no
    slots. An item shorter than a window must be found whole. Null or empty texts, on either side,
    match nothing; items without an id are left out; an item id with several texts is held if one
    of them is (the best match is told); rows that share an id are each reported (their text_hash tells them
    apart, and rows of equal texts are repeated). Other columns are ignored. An empty table on
    either side gives no rows.
    """
    out = "doc_id long, text_hash long, item_id long, first_word int, n_words int, n_windows int, item_windows int, slots_changed int"
    names = [c.split()[0] for c in out.split(", ")]
    items = written(benchmark_windows(benchmark, window), "benchmark")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most `window` numbers
    kept = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = document_windows(kept, bitmap(items), sizes)
    met = found.join(F.broadcast(items) if items.count() <= BROADCAST_ROWS else items, "h")
    # a row's repeats make its windows repeat: they are counted, and the result repeats as often
    key = ["doc_id", "text_hash", "item_id", "item_hash", "size", "item_windows"]
    seen = met.groupBy(*key, "k", "i", "h").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("first_word", "end_word", "own", "told")])
    groups = seen.groupBy(*key).agg(F.max("copies").alias("copies"), F.collect_list(F.struct("k", "i", "first_word", "end_word", "own", "told")).alias("windows"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g in batch.to_pylist():
                best = accepted({(w["k"], w["i"]): (w["first_word"], w["end_word"], w["own"], w["told"]) for w in g["windows"]}, g["size"], g["item_windows"])
                if best:
                    rows.append((g["doc_id"], g["text_hash"], g["item_id"], best[0], best[1], best[2], g["item_windows"], best[3], g["copies"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.int32(),) * 5 + (pa.int64(),))], [*names, "copies"])

    judged_ = groups.mapInArrow(judge, out + ", copies long")
    best = judged_.groupBy("doc_id", "text_hash", "item_id").agg(F.max("copies").alias("copies"), F.max(F.struct("n_windows", "first_word", "n_words", "item_windows", "slots_changed")).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", *[f"m.{c}" for c in names[3:]], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark: a row per document and item it holds."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
