"""Token ids in the Arrow stream-file format, as batches of fixed-size lists.

Documents are dealt to tasks by ranges of ``doc_id`` and each task writes one file: every row is
a sequence of ``width`` ids and a mask, so any sequence can be sliced from the memory-mapped file
without copying or decoding. A sidecar file in the same format holds each document's place. The
last sequence of a file is padded and its mask says so. Names of files end in the task's attempt,
and only files named by the manifest of successful tasks are read, so a lost executor costs a
rerun and leaves no half-written file in use.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runnel.llm.common import documents, new_folder, tokenizer, written

BATCH = 256


def open_folder(uri: str):
    """The file system and path of a folder's URI, whatever store it names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri)


def stream_schema(width: int, largest: int) -> pa.Schema:
    """Ids as narrow as the largest one allows; a bit of the mask for each."""
    return pa.schema([("ids", pa.list_(pa.uint16() if largest < 1 << 16 else pa.uint32(), width)), ("mask", pa.list_(pa.bool_(), width))])


class SequenceWriter:
    """Appends ids to one file, a batch of full sequences at a time."""

    def __init__(self, sink, width: int, largest: int = (1 << 32) - 1):
        self.width, self.rest, self.waiting, self.n = width, [], 0, 0
        self.schema = stream_schema(width, largest)
        self.file = pa.ipc.new_file(sink, self.schema)

    def append(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH * self.width:
            flat = np.concatenate(self.rest)
            while len(flat) >= BATCH * self.width:
                self._batch(flat[: BATCH * self.width], BATCH * self.width)
                flat = flat[BATCH * self.width :]
            self.rest, self.waiting = [flat], len(flat)

    def _batch(self, flat: np.ndarray, used: int) -> None:
        kinds = [self.schema.field(k).type.value_type for k in (0, 1)]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.width) for x, t in zip((flat, np.arange(len(flat)) < used), kinds)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([np.zeros(0, np.uint32), *self.rest])
        if used := len(flat):
            flat = np.concatenate([flat, np.zeros(-used % self.width, flat.dtype)])
            self._batch(flat, used)
        self.file.close()


class SequenceReader:
    """Random access to the sequences of one file; local files are memory-mapped."""

    def __init__(self, path: str):
        system, place = open_folder(path)
        local = system.type_name == "local"
        self.file = pa.ipc.open_file(pa.memory_map(place) if local else system.open_input_file(place))
        self.width = self.file.schema.field("ids").type.list_size

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file, from one or more batches."""
        per, out = BATCH * self.width, []
        while n > 0:
            k, at = divmod(start, per)
            flat = self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            out.append(flat[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, width: int = 2048) -> DataFrame:
    """Writes the files; returns the manifest: file, first_id, n_docs, n_tokens, base.

    ``docs`` needs doc_id and text; other columns are ignored. A null text is an empty one (only
    the end id is written). Null ids come first; rows of equal ids are ordered by text. An empty
    table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(vocabulary), np.array([end_id], np.uint32)
        system, place = open_folder(folder)
        sinks, out, ids_of, sizes = [], None, [], []
        name = f"{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                for doc_id, data in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist())):
                    if out is None:
                        sinks = [system.open_output_stream(f"{place}/{name}{x}") for x in ("", ".docs")]
                        out = SequenceWriter(sinks[0], width, max(end_id, tok.tokenizer.get_vocab_size() - 1))
                    ids = np.concatenate((np.frombuffer(data, np.uint32), end))
                    out.append(ids)
                    ids_of.append(doc_id)
                    sizes.append(len(ids))
        if out is not None:
            out.close()
            table = pa.table({"doc_id": pa.array(ids_of, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
            with pa.ipc.new_file(sinks[1], table.schema) as f:
                f.write_table(table)
            for s in sinks:
                s.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "first_id": pa.array(ids_of[:1], pa.int64()), "n_docs": [len(sizes)], "n_tokens": [out.n]})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(dealt.mapInArrow(write, "file string, first_id long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote: the window sees no document
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Reads files back, a task to each: doc_id, start (over all files), n_tokens, ids_crc32, and
    ids (binary) if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = SequenceReader(row["file"])
                system, place = open_folder(row["file"] + ".docs")
                index = pa.ipc.open_file(system.open_input_file(place)).read_all()
                sizes = index["n_tokens"].to_numpy()
                starts = np.cumsum(sizes) - sizes
                for lo in range(0, len(sizes), 1000):
                    s = slice(lo, lo + 1000)
                    ids = [reader.ids(a, n).astype("<u4").tobytes() for a, n in zip(starts[s].tolist(), sizes[s].tolist())]
                    out = {"doc_id": index["doc_id"].slice(lo, 1000).combine_chunks(), "start": starts[s] + row["base"], "n_tokens": sizes[s], "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
                    yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    # the manifest has a row for each file; ranges of as many names as there are files
    dealt = manifest.select("file", "base").repartitionByRange(max(1, manifest.count()), "file")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op4_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files and back; one row per document."""
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(manifest, with_ids=False)
