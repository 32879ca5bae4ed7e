"""Tensor containers as data sources: safetensors and GGUF files to rows, one a tensor.

The driver only lists files and their sizes. A task has a stretch of a file: it parses the header itself and reads the tensors
that start in its stretch, in order of offset. A filter on `name` reaches the reader, so that a point lookup reads one
tensor's bytes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .dequant import TYPES
from .hub import Repo

#: Limits of what a header may claim.
MAX_HEADER = 100 << 20
MAX_KEYS, MAX_TENSORS, MAX_ARRAY, MAX_DIMS, MAX_STRING = 1 << 16, 1 << 20, 1 << 24, 8, 1 << 20
#: Bytes of a file in which a task's tensors start.
TASK_BYTES = 128 << 20
ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
INDEX_NAMES = ("model.safetensors.index.json", "pytorch_model.safetensors.index.json")
#: Bytes of a value by safetensors' type (fixed values).
DTYPES = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}


@dataclass(frozen=True)
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int  # in the file
    end: int


def product(dims: tuple[int, ...]) -> int:
    n = 1
    for d in dims:
        n *= d
    return n


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sized(path: str, ending: str) -> list[tuple[str, int]]:
    """(file, bytes): the file itself, or the files below a folder with this ending, by name."""
    filesystem, at = locate(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    here = filesystem.get_file_info(at)
    if here.type == fs.FileType.Directory:
        found = filesystem.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted((f"{scheme}{f.path}", f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending))
    return [(path, here.size or 0)]


def of_headers(spark: SparkSession, path: str, ending: str, read: Callable[[BinaryIO], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `read` makes of each open file, after the file's name; each file is a task's."""
    files = [f for f, _ in sized(path, ending)]
    names = [x.split()[0] for x in schema.split(", ")]
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, ARROW[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
        for b in batches:
            for file in b.column(0).to_pylist():
                filesystem, at = locate(file)
                with filesystem.open_input_file(at) as f:
                    rows = [(file.rpartition("/")[2], *r) for r in read(f)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)], schema=kinds)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file").mapInArrow(run, schema)


def read_safetensors_header(f: BinaryIO) -> tuple[list[Tensor], dict[str, str]]:
    """Tensors by offset, and the file's metadata."""
    head = f.read(8)
    if len(head) < 8 or (size := struct.unpack("<Q", head)[0]) > MAX_HEADER:
        raise ValueError("not a safetensors file, or its header is too long")
    spec = json.loads(f.read(size))
    metadata = spec.pop("__metadata__", {})
    out = []
    for name, t in spec.items():
        if t["dtype"].upper() not in DTYPES:
            raise ValueError(f"{name}: unknown type {t['dtype']}")
        a, b = t["data_offsets"]
        if b - a != product(tuple(t["shape"])) * DTYPES[t["dtype"].upper()]:
            raise ValueError(f"{name}: {b - a} bytes don't hold its shape")
        out.append(Tensor(name, t["dtype"].upper(), tuple(t["shape"]), 8 + size + a, 8 + size + b))
    return sorted(out, key=lambda t: (t.start, t.name)), metadata


#: Scalar value types of GGUF: name and struct code (fixed values); 8 is a string, 9 an array.
SCALARS = {0: ("u8", "B"), 1: ("i8", "b"), 2: ("u16", "H"), 3: ("i16", "h"), 4: ("u32", "I"), 5: ("i32", "i"), 6: ("f32", "f"), 7: ("bool", "?"), 10: ("u64", "Q"), 11: ("i64", "q"), 12: ("f64", "d")}


class GGUF:
    """A GGUF header: version, alignment, key-values as (type, value), tensors by offset."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.read = f, 0
        if self._take(4) != b"GGUF":
            raise ValueError("not a GGUF file")
        self.version = self._one("I")
        if self.version < 2:
            raise ValueError(f"GGUF version {self.version} isn't supported")
        tensors, keys = self._one("Q"), self._one("Q")
        if tensors > MAX_TENSORS or keys > MAX_KEYS:
            raise ValueError("a GGUF header claims too much")
        self.values: dict[str, tuple[str, Any]] = {}
        for _ in range(keys):
            key = self._string()
            self.values[key] = self._value(self._one("I"))
        infos = [self._info() for _ in range(tensors)]
        self.alignment = int(self.values.get("general.alignment", ("u32", 32))[1]) or 32
        self.data = -(-self.read // self.alignment) * self.alignment
        self.tensors = []
        for name, shape, kind, offset in infos:
            t = TYPES.get(kind)
            if t is None:
                raise ValueError(f"{name}: unknown type {kind}")
            n = product(shape) if shape else 0
            self.tensors.append(Tensor(name, t.name, shape, self.data + offset, self.data + offset + -(-n // t.block) * t.size))
        self.tensors.sort(key=lambda t: (t.start, t.name))

    def _take(self, n: int) -> bytes:
        out = self.f.read(n)
        if len(out) < n:
            raise ValueError("a GGUF file ends early")
        self.read += n
        return out

    def _one(self, code: str) -> Any:
        return struct.unpack(f"<{code}", self._take(struct.calcsize(f"<{code}")))[0]

    def _string(self) -> str:
        if (n := self._one("Q")) > MAX_STRING:
            raise ValueError("a GGUF string is too long")
        return self._take(n).decode("utf-8", "replace")

    def _value(self, kind: int) -> tuple[str, Any]:
        if kind in SCALARS:
            name, code = SCALARS[kind]
            return name, self._one(code)
        if kind == 8:
            return "string", self._string()
        if kind != 9:
            raise ValueError(f"unknown GGUF value type {kind}")
        inner, n = self._one("I"), self._one("Q")
        if n > MAX_ARRAY:
            raise ValueError("a GGUF array is too long")
        if inner == 8:
            return "array<string>", [self._string() for _ in range(n)]
        if inner not in SCALARS:
            raise ValueError("nested GGUF arrays aren't supported")
        name, code = SCALARS[inner]
        return f"array<{name}>", list(struct.unpack(f"<{n}{code}", self._take(n * struct.calcsize(f"<{code}"))))

    def _info(self) -> tuple[str, tuple[int, ...], int, int]:
        """Dimensions as the file has them, the innermost first."""
        name, dims = self._string(), self._one("I")
        if dims > MAX_DIMS:
            raise ValueError(f"{name}: {dims} dimensions")
        return name, tuple(self._one("Q") for _ in range(dims)), self._one("I"), self._one("Q")

    @property
    def architecture(self) -> str:
        kind, value = self.values.get("general.architecture", ("", ""))
        return value if kind == "string" else ""


class Stretch(InputPartition):
    """Bytes low to high of a file; high is None for its end, file is None where there is nothing to read."""

    def __init__(self, file: str | None, low: int = 0, high: int | None = None) -> None:
        self.file, self.low, self.high = file, low, high


class TensorReader(DataSourceReader):
    def __init__(self, options: dict, kind: str) -> None:
        self.path, self.kind, self.names = options["path"], kind, None
        self.with_data = str(options.get("data", "true")).lower() != "false"
        self.index = options.get("index")

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for file, size in sized(self.path, f".{self.kind}"):
            cuts = [0, *range(TASK_BYTES, size, TASK_BYTES)] if self.with_data else [0]
            out += [Stretch(file, low, high) for low, high in zip(cuts, [*cuts[1:], None], strict=True)]
        return out or [Stretch(None)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.file is None:
            return
        filesystem, at = locate(partition.file)
        with filesystem.open_input_file(at) as f:
            for t in read_safetensors_header(f)[0] if self.kind == "safetensors" else GGUF(f).tensors:
                if t.start < partition.low or partition.high is not None and t.start >= partition.high or self.names is not None and t.name not in self.names:
                    continue
                data = None
                if self.with_data:
                    f.seek(t.start)
                    if len(data := f.read(t.end - t.start)) < t.end - t.start:
                        raise ValueError(f"{partition.file}: {t.name} ends early")
                yield partition.file.rpartition("/")[2], t.name, t.dtype, list(t.shape), t.start, t.end, data


class _TensorSource(DataSource):
    kind = ""

    def schema(self) -> str:
        return "file string, name string, dtype string, shape array<bigint>, start bigint, end bigint, data binary"

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options), self.kind)


class SafetensorsSource(_TensorSource):
    """Options: path (a file or a folder), data (false: no bytes are read)."""

    kind = "safetensors"

    @classmethod
    def name(cls) -> str:
        return "safetensors"


class GGUFSource(_TensorSource):
    """As SafetensorsSource; `shape` has the innermost dimension first, as the file has it."""

    kind = "gguf"

    @classmethod
    def name(cls) -> str:
        return "gguf"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SafetensorsSource, GGUFSource):
        spark.dataSource.register(source)


def tensors(spark: SparkSession, path: str, kind: str = "safetensors", data: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(kind).option("path", path).option("data", str(data).lower()).load()


def safetensors_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of the files' own metadata, read by the tasks."""
    return of_headers(spark, path, ".safetensors", lambda f: ((k, str(v)) for k, v in read_safetensors_header(f)[1].items()), "file string, key string, value string")


def shard_index(spark: SparkSession, folder: str) -> DataFrame:
    """(name, file): which shard holds a tensor, from the folder's index file, else from all files' headers."""
    filesystem, at = locate(folder)
    for name in INDEX_NAMES:
        if filesystem.get_file_info(f"{at}/{name}").type == fs.FileType.File:
            with filesystem.open_input_file(f"{at}/{name}") as f:
                return spark.createDataFrame(sorted(json.loads(f.read())["weight_map"].items()), "name string, file string")
    return tensors(spark, folder, data=False).select("name", "file")


def sharded(spark: SparkSession, folder: str, data: bool = True) -> DataFrame:
    """Tensors of the shards that the index names, each with its shard's header."""
    return tensors(spark, folder, data=data).join(shard_index(spark, folder), ["name", "file"], "left_semi")


def _told(f: BinaryIO) -> Iterator[tuple]:
    for key, (kind, v) in GGUF(f).values.items():
        whole = isinstance(v, int) and not isinstance(v, bool)
        yield (
            key, kind, v if isinstance(v, str) else None, v if whole and -(1 << 63) <= v < 1 << 63 else None, float(v) if whole or isinstance(v, float) else None,
            v if isinstance(v, bool) else None, json.dumps(v),
        )


def gguf_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, type, string_value, long_value, double_value, bool_value, json_value), read by the tasks; what doesn't fit its type is null.

    Unsigned 64-bit values beyond a long are in json_value only.
    """
    return of_headers(spark, path, ".gguf", _told, "file string, key string, type string, string_value string, long_value long, double_value double, bool_value boolean, json_value string")


def in_order(rows: DataFrame) -> DataFrame:
    """Tensors with `at`, their number in their file by offset, in order of file and offset."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("start", "name")) - 1).orderBy("file", "at")


def from_repo(spark: SparkSession, repo: Repo, kind: str = "safetensors", data: bool = True) -> DataFrame:
    """The tensors of a repository's files of this kind, fetched into its cache first, which executors must see."""
    repo.download([n for n in repo.names() if n.endswith(f".{kind}") or n.rpartition("/")[2] in INDEX_NAMES])
    return tensors(spark, repo.snapshot, kind, data)


def gguf_shapes(gguf: DataFrame) -> DataFrame:
    """With `dims`, the outermost dimension first, and `elements`, 0 without dimensions."""
    n = F.when(F.size("shape") == 0, F.lit(0).cast("long")).otherwise(F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x))
    return gguf.withColumn("dims", F.reverse("shape")).withColumn("elements", n)
