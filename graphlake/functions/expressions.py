"""Predicates over properties: small trees that know their properties and become Columns."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidError

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_CONNECT: dict[str, Callable[[Column, Column], Column]] = {"and": operator.and_, "or": operator.or_}


class Expression:
    """A node; logic is three-valued as in SQL."""

    def column(self) -> Column:
        raise NotImplementedError

    def properties(self) -> frozenset[str]:
        return frozenset()

    def _with(self, op: str, other: Any) -> Expression:
        return Binary(op, self, lift(other))

    def __eq__(self, other):  # type: ignore[override]
        return self._with("=", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._with("!=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __and__(self, other):
        return self._with("and", other)

    def __or__(self, other):
        return self._with("or", other)

    def __invert__(self):
        return Negation(self)

    __hash__ = object.__hash__


@dataclass(frozen=True, eq=False)
class Property(Expression):
    name: str

    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def properties(self) -> frozenset[str]:
        return frozenset({self.name})


@dataclass(frozen=True, eq=False)
class Literal(Expression):
    value: Any

    def column(self) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True, eq=False)
class Negation(Expression):
    of: Expression

    def column(self) -> Column:
        return ~self.of.column()

    def properties(self) -> frozenset[str]:
        return self.of.properties()


@dataclass(frozen=True, eq=False)
class Binary(Expression):
    op: str
    left: Expression
    right: Expression

    def column(self) -> Column:
        return (_COMPARE | _CONNECT)[self.op](self.left.column(), self.right.column())

    def properties(self) -> frozenset[str]:
        return self.left.properties() | self.right.properties()


def lift(value: Any) -> Expression:
    """A value as a Literal; expressions as they are; None is refused."""
    if value is None:
        raise InvalidError("an operand is missing")
    return value if isinstance(value, Expression) else Literal(value)


def check_members(wanted: frozenset[str] | set[str], group: list[str], always: tuple[str, ...] = ()) -> None:
    """All wanted names must be in one group (index columns aside)."""
    if other := sorted(set(wanted) - set(group) - set(always)):
        raise InvalidError(f"not in the property group {group}: {other}")
