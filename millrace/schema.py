"""Schemas: ordered, uniquely and case-sensitively named columns of the five element types (and int64)."""

from __future__ import annotations

import dataclasses
import datetime
import json
import types
import typing

from pyspark.sql import types as T

#: Python type of a field: the Spark type of its column.
ELEMENT_TYPES: dict[type, T.DataType] = {int: T.IntegerType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(), datetime.datetime: T.TimestampNTZType()}
NAMES: dict[str, T.DataType] = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "timestamp": T.TimestampNTZType()}


@dataclasses.dataclass(frozen=True)
class ColumnDef:
    """A column: type is a name of NAMES; source_index picks a physical column of a text file."""

    name: str
    type: str
    nullable: bool = False
    source_index: int | None = None

    @property
    def spark_type(self) -> T.DataType:
        if self.type not in NAMES:
            raise TypeError(f"column {self.name!r}: unsupported type {self.type!r}")
        return NAMES[self.type]


class Schema:
    """An ordered list of column definitions."""

    def __init__(self, columns: typing.Iterable[ColumnDef]):
        self.columns = tuple(columns)
        names = [c.name for c in self.columns]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"duplicate column names: {sorted(twice)}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.columns == other.columns

    def __len__(self) -> int:
        return len(self.columns)

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def index(self, name: str) -> int:
        for i, c in enumerate(self.columns):
            if c.name == name:
                return i
        raise KeyError(f"no column {name!r}")

    def __getitem__(self, name: str) -> ColumnDef:
        return self.columns[self.index(name)]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, c.nullable) for c in self.columns])

    def to_json(self) -> str:
        """Names, types and nullability; the place in a source file isn't part of a schema."""
        return json.dumps([{"name": c.name, "type": c.type, "nullable": c.nullable} for c in self.columns])

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls(ColumnDef(c["name"], c["type"], c["nullable"]) for c in json.loads(text))

    @classmethod
    def from_struct(cls, struct: T.StructType) -> Schema:
        of = {v: k for k, v in NAMES.items()}
        return cls(ColumnDef(f.name, of[f.dataType], f.nullable) for f in struct)

    @classmethod
    def from_class(cls, kind: type) -> Schema:
        """From an annotated class: fields of other types are left out; text and optional fields are nullable."""
        out = []
        for name, hint in typing.get_type_hints(kind).items():
            options = typing.get_args(hint) if typing.get_origin(hint) in (typing.Union, types.UnionType) else (hint,)
            kinds = [o for o in options if o is not type(None)]
            if len(kinds) == 1 and kinds[0] in ELEMENT_TYPES:
                spark_type = ELEMENT_TYPES[kinds[0]]
                out.append(ColumnDef(name, next(k for k, v in NAMES.items() if v == spark_type), kinds[0] is str or len(options) > 1))
        return cls(out)
