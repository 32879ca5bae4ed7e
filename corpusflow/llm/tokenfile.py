"""Token ids in Arrow IPC files of fixed-size lists.

A corpus' ids, in order of doc_id, are one stream; each file holds a stretch of it, cut into sequences of equal length, as
columns ids (fixed_size_list<uint16 or uint32>) and mask (fixed_size_list<bool>, one bit a token, false where the last
sequence is filled up).
All record batches of a file but the last have equally many sequences, so that any sequence or document of a memory-mapped
file is a view without a copy. Beside it an index file has each document's doc_id, start in the file and number of ids.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TextEncoder, vocabulary
from .common import bounded_batches, over_arrow, shared_dir, with_columns_of

SEQUENCE, SEQUENCES = 2048, 64
#: Different words that a worker remembers, as the library takes long over a new one.
MEMO = 700_000
INDEX_ROWS = 4096


class LibraryWords:
    """Distinct words by the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths


@lru_cache(2)
def library(path: str) -> TextEncoder:
    """Encodes each different word of a text once; the words are those that the library itself cuts texts into."""
    return TextEncoder(vocabulary(path), LibraryWords(path), MEMO)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class Writer:
    """One file and its index. Both get their names when they are whole, so that a retried task replaces what a lost one wrote."""

    def __init__(self, uri: str, part: int, wide: bool, sequence: int = SEQUENCE) -> None:
        self.fs, self.folder = open_folder(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.names = [f"{self.folder}/{kind}-{part:06d}.arrow" for kind in ("ids", "index")]
        self.drafts = [f"{n}.{uuid.uuid4().hex}.draft" for n in self.names]
        self.type, self.sequence = (pa.uint32() if wide else pa.uint16()), sequence
        schema = pa.schema([("ids", pa.list_(self.type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(d) for d in self.drafts]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (schema, index), strict=True)]
        self.schema, self.index_schema = schema, index
        self.held, self.size, self.rows, self.total, self.docs = [], 0, [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total, self.docs = self.total + len(ids), self.docs + 1
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.sequence * SEQUENCES:
            self.flush(False)
        if len(self.rows) >= INDEX_ROWS:
            self.flush_index()

    def flush(self, last: bool) -> None:
        whole = self.sequence * SEQUENCES
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for at in range(0, len(ids) if last else len(ids) // whole * whole, whole):
            some = ids[at : at + whole]
            fill = -len(some) % self.sequence
            values = np.concatenate([some, np.zeros(fill, some.dtype)]).astype(self.type.to_pandas_dtype())
            mask = np.arange(len(values)) < len(some)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (values, mask)]
            self.files[0].write_batch(pa.record_batch(arrays, schema=self.schema))
        rest = ids[len(ids) // whole * whole :]
        self.held, self.size = ([], 0) if last else ([rest], len(rest))

    def flush_index(self) -> None:
        if self.rows:
            self.files[1].write_batch(pa.record_batch([pa.array([r[i] for r in self.rows], pa.int64()) for i in range(3)], schema=self.index_schema))
        self.rows = []

    def close(self) -> tuple[str, str]:
        self.flush(True)
        self.flush_index()
        for f, s in zip(self.files, self.sinks, strict=True):
            f.close()
            s.close()
        for draft, name in zip(self.drafts, self.names, strict=True):
            self.fs.move(draft, name)
        return self.names[0], self.names[1]


class Reader:
    """Views on a file written by Writer; a local file is mapped into memory."""

    def __init__(self, filesystem: fs.FileSystem, name: str) -> None:
        local = isinstance(filesystem, fs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else filesystem.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _values(self, n: int) -> np.ndarray:
        if self.at != n:
            self.at, self.batch = n, self.file.get_batch(n)
        return self.batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence_of(self, n: int) -> np.ndarray:
        """Sequence n, without a copy."""
        batch, row = divmod(n, SEQUENCES)
        return self._values(batch)[row * self.sequence : (row + 1) * self.sequence]

    def mask_of(self, n: int) -> pa.BooleanArray:
        """The mask of sequence n, without a copy: a view on the file's bits."""
        batch, row = divmod(n, SEQUENCES)
        self._values(batch)
        return self.batch.column(1).flatten().slice(row * self.sequence, self.sequence)

    def mask_bits(self, n: int) -> np.ndarray:
        """The same as bytes of eight flags, low bits first, without a copy; sequences must be whole bytes long."""
        if self.sequence % 8:
            raise ValueError("the sequence length must be a multiple of 8")
        mask = self.mask_of(n)
        return np.frombuffer(mask.buffers()[1], np.uint8, self.sequence // 8, mask.offset // 8)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start, start + 1, ...; without a copy if they lie in one record batch."""
        whole, parts = self.sequence * SEQUENCES, []
        while n > 0:
            batch, at = divmod(start, whole)
            parts.append(self._values(batch)[at : at + n])
            if not len(parts[-1]):
                raise ValueError("a token file ends early")
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def close(self) -> None:
        self.batch = self.file = None
        self.source.close()


def write(docs: DataFrame, path: str, folder: str, end: int = 2, sequence: int = SEQUENCE) -> list[tuple[int, str, str, int, int]]:
    """Encodes docs by the tokenizers library, `end` after each, into `folder`: (part, ids file, index file, ids, documents) in stream order.

    Rows go by doc_id (null first), those of one doc_id by their text's hash; equal rows may come from several files. Null texts are empty: they have the end id only.
    One entry a file comes to the driver.
    """
    bounded_batches(docs.sparkSession)
    rows = with_columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("i", F.monotonically_increasing_id())  # so that equal rows, however many, aren't one range
    ordered = rows.repartitionByRange("doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "i").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = library(path), None, TaskContext.get().partitionId()
        stop = np.array([end], np.uint32)
        for b in batches:
            writer = writer or Writer(folder, part, encoder.v.size > 1 << 16, sequence)
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                writer.add(key, np.concatenate([ids, stop]))
        if writer:
            names = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "ids": names[0], "index": names[1], "tokens": writer.total, "docs": writer.docs}])

    found = over_arrow(ordered, run, "part long, ids string, index string, tokens long, docs long").collect()
    return sorted((r["part"], r["ids"], r["index"], r["tokens"], r["docs"]) for r in found)


def read(spark: SparkSession, folder: str, files: list[tuple[int, str, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start counts all ids before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *(f[3] for f in files)]).tolist()
    listed = spark.createDataFrame([(f[1], f[2], b) for f, b in zip(files, before, strict=False)], "ids string, index string, base long")

    def run(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_folder(folder)
        for b in batches:
            for ids, index, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reader = Reader(filesystem, ids)
                with filesystem.open_input_file(index) as source:
                    entries = pa.ipc.open_file(source)
                    for n in range(entries.num_record_batches):
                        some = entries.get_batch(n)
                        sums = [zlib.crc32(reader.ids(s, k).astype("<u4").tobytes()) for s, k in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                        starts = pa.array(some.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([some.column(0), starts, some.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    return listed.repartition(len(files), "ids").mapInArrow(partial(run, folder=folder), schema)


def token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """read() of what write() made of docs, in `folder` (a new one in the shared folder). A row for each row; an empty table gives none."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/corpusflow/tokens-{uuid.uuid4().hex}"
    return read(spark, folder, write(docs, path, folder))
