"""Conditions over the columns of one table, as trees that become Spark columns (or SQL text for explanations)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ShapeframeError

#: How a comparison reads in SQL.
_SQL = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@dataclass(frozen=True)
class Condition:
    """``op`` over a column and a value, or over other conditions. Combine with ``&``, ``|`` and ``~``."""

    op: str
    column: str = ""
    value: Any = None
    parts: tuple[Condition, ...] = ()

    def __and__(self, other: Condition) -> Condition:
        return Condition.all([self, other])

    def __or__(self, other: Condition) -> Condition:
        return Condition.any([self, other])

    def __invert__(self) -> Condition:
        return Condition("not", parts=(self,))

    @staticmethod
    def all(parts: Iterable[Condition]) -> Condition:
        """True if all are; of none, true."""
        return Condition("and", parts=tuple(q for p in parts for q in (p.parts if p.op == "and" else (p,))))

    @staticmethod
    def any(parts: Iterable[Condition]) -> Condition:
        """True if one is; of none, false."""
        return Condition("or", parts=tuple(q for p in parts for q in (p.parts if p.op == "or" else (p,))))

    def columns(self) -> set[str]:
        return {self.column} - {""} | {c for p in self.parts for c in p.columns()}

    def to_column(self, resolve: Callable[[str], Column]) -> Column:
        parts = [p.to_column(resolve) for p in self.parts]
        if self.op == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True)) if not parts else reduce(lambda a, b: a & b, parts)
        if self.op == "or":
            return F.lit(False) if not parts else reduce(lambda a, b: a | b, parts)
        if self.op == "not":
            return ~parts[0]
        c, v = resolve(self.column), self.value
        if self.op in ("in", "not_in"):
            if not v:
                return F.lit(self.op == "not_in")
            return c.isin(*v) if self.op == "in" else ~c.isin(*v)
        if self.op in ("is_null", "is_not_null"):
            return c.isNull() if self.op == "is_null" else c.isNotNull()
        if self.op in ("like", "ilike"):
            return c.like(v) if self.op == "like" else c.ilike(v)
        compare = {"eq": c.__eq__, "ne": c.__ne__, "lt": c.__lt__, "le": c.__le__, "gt": c.__gt__, "ge": c.__ge__}
        return compare[self.op](F.lit(v))

    def to_sql(self, quote: Callable[[str], str]) -> str:
        """The condition as text, values left out as ``?``."""
        if self.op in ("and", "or"):
            return "(" + f" {self.op.upper()} ".join(p.to_sql(quote) for p in self.parts) + ")" if self.parts else str(self.op == "and").upper()
        if self.op == "not":
            return f"NOT ({self.parts[0].to_sql(quote)})"
        c = quote(self.column)
        if self.op in ("in", "not_in"):
            return (f"{c} IN (?)" if self.op == "in" else f"NOT ({c} IN (?))") if self.value else str(self.op == "not_in").upper()
        if self.op in ("is_null", "is_not_null"):
            return f"{c} IS {'NOT ' * (self.op == 'is_not_null')}NULL"
        return f"{c} {_SQL.get(self.op, self.op.upper())} ?"


def _same_kind(column: str, values: list[Any]) -> tuple[Any, ...]:
    kinds = {type(v) for v in values if v is not None}
    if len(kinds) > 1:
        raise ShapeframeError("", column, "the values of a list have different types")
    return tuple(values)


@dataclass(frozen=True)
class col:  # noqa: N801 reads as a function
    """A column of the view's own table, to be compared."""

    name: str

    def eq(self, v: Any) -> Condition:
        return Condition("eq", self.name, v)

    def ne(self, v: Any) -> Condition:
        return Condition("ne", self.name, v)

    def lt(self, v: Any) -> Condition:
        return Condition("lt", self.name, v)

    def le(self, v: Any) -> Condition:
        return Condition("le", self.name, v)

    def gt(self, v: Any) -> Condition:
        return Condition("gt", self.name, v)

    def ge(self, v: Any) -> Condition:
        return Condition("ge", self.name, v)

    def is_null(self) -> Condition:
        return Condition("is_null", self.name)

    def is_not_null(self) -> Condition:
        return Condition("is_not_null", self.name)

    def is_in(self, values: Iterable[Any]) -> Condition:
        return Condition("in", self.name, _same_kind(self.name, list(values)))

    def not_in(self, values: Iterable[Any]) -> Condition:
        return Condition("not_in", self.name, _same_kind(self.name, list(values)))

    def like(self, pattern: str) -> Condition:
        return Condition("like", self.name, pattern)

    def ilike(self, pattern: str) -> Condition:
        return Condition("ilike", self.name, pattern)


@dataclass
class Nested:
    """Filter, order and page for the elements of a collection, for each parent."""

    condition: Condition | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit_: int | None = None
    offset_: int = 0

    def filter(self, condition: Condition) -> Nested:
        self.condition = condition if self.condition is None else self.condition & condition
        return self

    def order_by(self, column: str) -> Nested:
        self.order.append((column, False))
        return self

    def order_by_desc(self, column: str) -> Nested:
        self.order.append((column, True))
        return self

    def limit(self, n: int) -> Nested:
        self.limit_ = n
        return self

    def offset(self, n: int) -> Nested:
        self.offset_ = n
        return self
