"""Schemas to reports and to generated source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.names import ACRONYMS

PHYSICAL = [
    (T.BooleanType, "BOOLEAN"), ((T.ByteType, T.ShortType, T.IntegerType, T.DateType), "INT32"), ((T.LongType, T.TimestampType, T.TimestampNTZType), "INT64"), (T.FloatType, "FLOAT"),
    (T.DoubleType, "DOUBLE"), (T.StringType, "BYTE_ARRAY"), (T.BinaryType, "BYTE_ARRAY"), (T.DecimalType, "FIXED_LEN_BYTE_ARRAY"),
]
PYTHON = {"BOOLEAN": "bool", "INT32": "int", "INT64": "int", "FLOAT": "float", "DOUBLE": "float", "BYTE_ARRAY": "str", "FIXED_LEN_BYTE_ARRAY": "str"}


def camel(name: str) -> str:
    return "".join(p.upper() if p.lower() in ACRONYMS else p[:1].upper() + p[1:] for p in name.split("_"))


def physical_type(kind: T.DataType) -> str:
    return next((name for types, name in PHYSICAL if isinstance(kind, types)), "GROUP" if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else "ANY")


def report(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """(path, name, physical_type, spark_type, repeated) of every field at any depth, `path` with dots."""
    rows: list[tuple] = []

    def walk(fields: list[T.StructField], above: str) -> None:
        for f in fields:
            kind, repeated = f.dataType, False
            while isinstance(kind, T.ArrayType):
                kind, repeated = kind.elementType, True
            rows.append((f"{above}{f.name}", camel(f.name), physical_type(kind), f.dataType.simpleString(), repeated))
            if isinstance(kind, T.StructType):
                walk(kind.fields, f"{above}{f.name}.")

    walk(schema.fields, "")
    return spark.createDataFrame(rows, "path string, name string, physical_type string, spark_type string, repeated boolean")


def generate(schema: T.StructType, root: str) -> str:
    """Dataclasses for a record: `root` and an `...Item` for each group, in order of need, with the declared DDL."""
    blocks: list[str] = []

    def annotation(name: str, kind: T.DataType) -> str:
        if isinstance(kind, T.ArrayType):
            return f"list[{annotation(name, kind.elementType)}]"
        if isinstance(kind, T.MapType):
            return f"dict[{annotation(name, kind.keyType)}, {annotation(name, kind.valueType)}]"
        if isinstance(kind, T.StructType):
            emit(f"{camel(name)}Item", kind)
            return f"{camel(name)}Item"
        return PYTHON.get(physical_type(kind), "object")

    def emit(name: str, struct: T.StructType) -> None:
        lines = [f"    {f.name}: {annotation(f.name, f.dataType)}  # {camel(f.name)}" for f in struct.fields]
        blocks.append("\n".join(["@dataclass", f"class {name}:", *(lines or ["    pass"])]))

    emit(root, schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return "\n\n\n".join(["from dataclasses import dataclass", *blocks, f"SCHEMA = {ddl!r}"]) + "\n"


def record_name(dataset: str) -> str:
    return camel(dataset.rpartition("/")[2]) + "Record"
