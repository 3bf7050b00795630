"""Shared pieces of the corpus operators: written tables, word hashing, cached tokenization."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t to \r.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Folders written by this process, by the scope they were written in, and the tables that read them.
_FOLDERS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPE = ["query"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is taken, if driver and executors are one process; on a
    cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="runnel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own; it goes with the driver, if it is not discarded before."""
    path = f"{shared_dir(spark)}/runnel-{name}-{uuid.uuid4().hex}"
    p, system = _hadoop(spark, path)
    system.mkdirs(p)
    system.deleteOnExit(p)
    _FOLDERS[path] = _SCOPE[-1]
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    p, system = _hadoop(spark, path)
    system.delete(p, True)
    system.cancelDeleteOnExit(p)
    _FOLDERS.pop(path, None)


def discard_table(table: DataFrame) -> None:
    """Deletes the files of one ``written`` table that no later step reads."""
    if path := _PATHS.pop(table, None):
        discard(table.sparkSession, path)


@contextlib.contextmanager
def stage_scope(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """For a stage of the pipeline: folders of earlier stages go, save those that ``docs`` reads;
    tables of single queries stay."""
    used = docs.inputFiles() if "pipeline" in _FOLDERS.values() else []
    for path in [p for p, scope in _FOLDERS.items() if scope == "pipeline"]:
        if not any(path.rpartition("/")[2] in f for f in used):
            discard(spark, path)
    _SCOPE.append("pipeline")
    try:
        yield
    finally:
        _SCOPE.pop()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as far as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id) -> F.Column:
    """True for the rows that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


# --- hashing of word sequences -------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**60)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordSequence:
    """Hashes of any run of consecutive words of one document, from prefix sums over its bytes."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        if self.n:
            data = np.frombuffer(b" ".join(words), dtype=np.uint8)
            size = 1 << max(12, int(len(data)).bit_length())
            power, self.inverse = _powers(size)
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])
            gaps = np.flatnonzero(data == 32)
            self.starts = np.concatenate(([0], gaps + 1))
            self.ends = np.concatenate((gaps, [len(data)]))

    def runs(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` words, in order; none where there are fewer words."""
        if self.n < k:
            return np.zeros(0, dtype=np.uint64)
        s, e = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        return mix((self.sums[e] - self.sums[s]) * self.inverse[s])


# --- tokenization --------------------------------------------------------------------------

#: White space beyond ASCII, separators that libraries class differently, and characters whose
#: lower case or composition depends on their neighbours.
_ODD = re.compile("[\0-\x08\x0e-\x1f\x85\xa0\u0300-\u036f\u0345\u03a3\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\t\x0b-\r]")
#: A word of one id in the vocabulary without spaces, put between pieces.
_MARK = "~"
_ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class CachedTokenizer:
    """Ids of whole texts by a public tokenizer, encoding each distinct piece once per worker.

    Both vocabularies split a text into pieces before merging, and a single space or newline
    between two other characters always ends a piece; so does the border of a letter and
    punctuation behind it. The texts of a call are cut there, each distinct piece is encoded by the
    library, many to a call, and the ids (bytes, unsigned 32-bit little-endian) are joined, by
    Arrow's kernels, so that Python sees distinct pieces only. Texts with other white space are
    encoded whole. The cache has two generations: the older one goes once the younger holds half of
    ``limit`` pieces, so memory is bounded.
    """

    def __init__(self, name: str, limit: int = 600_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.spaced = name.startswith("byte")  # a piece holds the space before it
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space or newline
        self.begins[[k for t, k in vocabulary.items() if t[0] in "\u0120\u010a"]] = True
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.limit, self.cache, self.older = limit, {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _together(self, pieces: list[str]) -> None:
        """Encodes pieces in one text and cuts its ids between them."""
        told = "".join([p if p[0] == "\n" else " " + p for p in pieces]) if self.spaced else "".join([f"{p} {_MARK} " for p in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([told], add_special_tokens=False)[0].ids, "<u4")
        if self.spaced:
            starts = np.flatnonzero(self.begins[ids])
            ends = np.append(starts[1:], len(ids))
        else:
            ends = np.flatnonzero(ids == self.mark[0])
            starts = np.append(0, ends + 1)[: len(ends)]
        if len(starts) != len(pieces):
            self.cache.update(zip(pieces, self._encode([p if p[0] == "\n" or not self.spaced else " " + p for p in pieces])))
            return
        data = ids.tobytes()
        self.cache.update(zip(pieces, [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of pieces that are not there into the cache; None for those whose texts are encoded whole."""
        cache, older = self.cache, self.older
        cache.update([(p, older[p]) for p in pieces if p in older])
        new = [p for p in pieces if p not in cache]
        # the first piece of a text has no space before it: a leading \0 marks that
        apart = [p for p in new if not p or p[0] == "\0" or p == "\n"] if self.spaced else [p for p in new if not p or _MARK in p]
        if apart:
            single = [p for p in apart if p not in ("", "\0", "\n") and not _ODD.search(p[self.spaced :])]
            cache.update(dict.fromkeys(apart))
            cache.update(zip(single, self._encode([p[self.spaced :] for p in single])))
            if not self.spaced:
                cache[""] = b""
            new = [p for p in new if p not in cache]
        if _ODD.search("".join(new)):
            odd = {p for p in new if _ODD.search(p)}
            cache.update(dict.fromkeys(odd))
            new = [p for p in new if p not in odd]
        for lo in range(0, len(new), 2000):
            self._together(new[lo : lo + 2000])

    def _ids(self, pieces: list[str]) -> pa.LargeBinaryArray:
        cache = self.cache
        if new := [p for p in pieces if p not in cache]:
            self._learn(new)
        return pa.array(list(map(cache.__getitem__, pieces)), pa.large_binary())

    def _ended(self, pieces: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, list[str]]:
        """The pieces without the punctuation that ends them, which of these ends each had (0: none), and the ends."""
        bases = pc.ascii_rtrim(pieces, characters=_ENDS)
        ends, data = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + 1 :][: len(pieces)], np.frombuffer(pieces.buffers()[2], np.uint8)
        size = pc.binary_length(pieces).to_numpy()
        kept = pc.binary_length(bases).to_numpy()
        # a base ends in a letter of ASCII or Latin-1; at most 8 characters follow it
        some = np.flatnonzero((kept < size) & (kept > 0) & (size - kept <= 8))
        at = ends[some] - (size - kept)[some]
        last, before = data[at - 1], data[at - 2] * (kept[some] > 1)
        letter = (last | 32) - np.uint8(97) < 26
        letter |= (before == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80)
        some, at = some[letter], at[letter]
        codes = np.zeros(len(some), np.uint64)
        for k in range(8):
            there = at + k < ends[some]
            codes[there] |= data[(at + k)[there]].astype(np.uint64) << np.uint64(8 * k)
        told, which = np.unique(codes, return_inverse=True)
        tails, cut = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), bool)
        tails[some], cut[some] = which + 1, True
        return pc.if_else(pa.array(cut), bases, pieces), tails, [x.tobytes().rstrip(b"\0").decode() for x in told.astype("<u8")]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > self.limit // 2:
            self.older, self.cache = self.cache, {}
        odd = [k for k, t in enumerate(texts) if t and "\0" in t]  # these would look like first pieces
        ready = [t and ("\0" + t.replace("\n", " \n") if self.spaced else t.replace("\n", " ")) for t in texts]
        for k in odd:
            ready[k] = None
        split = pc.split_pattern(pa.array(ready, pa.large_string()), " ")
        pieces = split.flatten()
        if not len(pieces):  # nothing but empty texts and odd ones
            return self._encode([t or "" for t in texts])
        found = pieces.dictionary_encode()
        bases, tails, told = self._ended(found.dictionary)
        bases = (bases if self.spaced else pc.ascii_lower(bases)).dictionary_encode()
        ids = self._ids(bases.dictionary.to_numpy(zero_copy_only=False).tolist()).take(bases.indices)
        if told:
            ends = pa.concat_arrays([pa.array([b""], pa.large_binary()), self._ids(["\0" + t if self.spaced else t for t in told])])
            ids = pc.binary_join_element_wise(ids, ends.take(pa.array(tails)), pa.scalar(b"", pa.large_binary()))
        ids = ids.take(found.indices)
        borders = split.offsets.to_numpy()
        whole = np.unique(np.searchsorted(borders, np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)), "right") - 1).tolist() if ids.null_count else []
        whole += odd
        data, places = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int64)[borders].tolist()
        out = [bytes(data[a:b]) for a, b in zip(places, places[1:])]
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]) if whole else []):
            out[k] = ids
        return out


@functools.lru_cache(maxsize=1)
def tokenizer(name: str) -> CachedTokenizer:
    """One at a time per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for kept in KEPT:
        kept.clear()
    return CachedTokenizer(name)


#: What workers keep from task to task, by operator: emptied when the worker turns to another one.
KEPT: list[dict] = []


def fresh_worker(own: dict | None = None) -> None:
    """Frees what other operators' tasks have left in this worker process; ``own`` stays."""
    import gc

    if tokenizer.cache_info().currsize or any(k for k in KEPT if k is not own):
        tokenizer.cache_clear()
        for kept in KEPT:
            if kept is not own:
                kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
