"""Property types and cardinalities, and how they map to Spark's types."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from ..errors import InvalidError, TypeMismatchError

_ATOMS: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}
_ALIASES = {"boolean": "bool", "int": "int32", "integer": "int32", "long": "int64", "bigint": "int64", "str": "string"}
_LIST_OF = ("int32", "int64", "float", "double", "string")


class Cardinality(Enum):
    SINGLE = "single"
    LIST = "list"
    SET = "set"

    @classmethod
    def parse(cls, name: str | None) -> Cardinality:
        try:
            return cls((name or "single").lower())
        except ValueError as e:
            raise InvalidError(f"unknown cardinality {name!r}") from e


@dataclass(frozen=True)
class GType:
    """A property type: one of the atoms, or a list of one."""

    name: str
    element: str | None = None

    @classmethod
    def parse(cls, text: str) -> GType:
        """Reads `int32`, `list<float>`, the aliases of atoms, and a bare `list` (of strings)."""
        name = str(text).strip().lower()
        name = _ALIASES.get(name, name)
        if name in _ATOMS:
            return cls(name)
        m = re.fullmatch(r"list(?:\s*<\s*(\w+)\s*>)?", name)
        if m:
            element = _ALIASES.get(m[1] or "string", m[1] or "string")
            if element in _LIST_OF:
                return cls("list", element)
        raise InvalidError(f"unknown type {text!r}")

    @classmethod
    def from_spark(cls, kind: T.DataType) -> GType:
        if isinstance(kind, T.ArrayType):
            element = cls.from_spark(kind.elementType)
            if element.name in _LIST_OF:
                return cls("list", element.name)
        if isinstance(kind, (T.ShortType, T.ByteType)):
            return cls("int32")
        if isinstance(kind, (T.TimestampNTZType, T.CharType, T.VarcharType)):
            return cls("timestamp" if isinstance(kind, T.TimestampNTZType) else "string")
        for name, atom in _ATOMS.items():
            if kind == atom:
                return cls(name)
        raise TypeMismatchError(f"no property type for {kind.simpleString()}")

    def spark(self, cardinality: Cardinality = Cardinality.SINGLE) -> T.DataType:
        own = T.ArrayType(_ATOMS[self.element]) if self.name == "list" else _ATOMS[self.name]
        return own if cardinality is Cardinality.SINGLE else T.ArrayType(own)

    def __str__(self) -> str:
        return f"list<{self.element}>" if self.name == "list" else self.name
