"""Ingestion rules: a text language, its meaning as a Spark column and as a Python function.

``op:insert,update; status == O; amount >= 5``: parts are cut at semicolons, an ``op:`` list restricts operations, other
parts compare a column with a value. Parts that make no sense are left out, so parsing never fails. Comparison is of
text, byte by byte. A comparison with a value that is missing or NULL is false, whatever its operator, but for
``is_null``. Rules look at the row after the change; where there is none (delete, truncate) they let the event pass.

``typed`` comparisons cast both sides instead and are an option of the same rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import OPS, is_table, text

#: Operators that the text language knows, in the order in which they are looked for.
SYMBOLS = (("!=", "neq"), (">=", "gte"), ("<=", "lte"), ("==", "eq"), (">", "gt"), ("<", "lt"))


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Rule:
    ops: frozenset[str] = frozenset()
    predicates: tuple[Predicate, ...] = ()


_COMPARE: dict[str, Callable] = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "gte": lambda a, b: a >= b,
    "lte": lambda a, b: a <= b,
}


def _tag(tag: str) -> str | None:
    return next((op for op in OPS if tag in (op, op.upper(), op[0].upper())), None)


def parse(expression: str) -> Rule:
    ops: set[str] = set()
    predicates: list[Predicate] = []
    for part in map(str.strip, expression.split(";")):
        if part.startswith("op:"):
            ops |= {op for op in map(_tag, map(str.strip, part[3:].split(","))) if op}
        elif found := next(((s, name) for s, name in SYMBOLS if s in part), None):
            left, _, right = part.partition(found[0])
            if left.strip():
                predicates.append(Predicate(left.strip(), found[1], right.strip()))
    return Rule(frozenset(ops), tuple(predicates))


def compare(value: Column, op: str, wanted: str, kind: str | None = None) -> Column:
    """One comparison, never null; ``kind`` is a Spark type for a typed one."""
    if op == "is_null":
        return value.isNull()
    if op == "is_not_null":
        return value.isNotNull()
    if op == "contains":
        result = value.contains(F.lit(wanted))
    elif op == "starts_with":
        result = value.startswith(F.lit(wanted))
    else:
        sides = (value, F.lit(wanted)) if kind is None else (value.try_cast(kind), F.lit(wanted).try_cast(kind))
        result = _COMPARE[op](*sides)
    return F.coalesce(result, F.lit(False))


def holds(predicate: Predicate, row: dict[str, str | None]) -> bool:
    """The same in Python."""
    value = row.get(predicate.column)
    if predicate.op == "is_null":
        return value is None
    if value is None:
        return False
    if predicate.op == "is_not_null":
        return True
    if predicate.op == "contains":
        return predicate.value in value
    if predicate.op == "starts_with":
        return value.startswith(predicate.value)
    return _COMPARE[predicate.op](value.encode(), predicate.value.encode())


def column(rule: Rule, types: dict[str, str] | None = None, value: Callable[[str], Column] | None = None, after: Column | None = None) -> Column:
    """Whether a rule accepts an event.

    ``value`` gives a column of a row by name (default: of the generic ``after``); a typed log gives its own.
    """
    after = F.col("after") if after is None else after
    value = value or (lambda name: text(after, name))
    types = types or {}
    accepted = F.col("op").isin(*sorted(rule.ops)) if rule.ops else F.lit(True)
    if rule.predicates:
        every = reduce(lambda a, b: a & b, (compare(value(p.column), p.op, p.value, types.get(p.column)) for p in rule.predicates))
        accepted = accepted & (after.isNull() | every)
    return accepted


def accepts(rule: Rule, op: str, after: dict[str, str | None] | None) -> bool:
    """The same in Python."""
    return (not rule.ops or op in rule.ops) and (after is None or all(holds(p, after) for p in rule.predicates))


@dataclass
class RuleSet:
    """Rules by qualified table; a table without one is accepted as it is."""

    rules: dict[str, Rule] = field(default_factory=dict)

    @staticmethod
    def from_config(filters: dict[str, str]) -> RuleSet:
        return RuleSet({t: parse(e) for t, e in filters.items()})

    def add(self, table: str, rule: Rule | str) -> None:
        """Set a table's rule; a later one replaces it."""
        self.rules[table] = parse(rule) if isinstance(rule, str) else rule

    def column(self) -> Column:
        found = F.lit(True)
        for table, rule in self.rules.items():
            found = F.when(is_table(table), column(rule)).otherwise(found)
        return found

    def apply(self, log: DataFrame) -> DataFrame:
        return log.where(self.column()) if self.rules else log


@dataclass(frozen=True)
class ReadFilter:
    """What a reader asks for: tables (none: all; an empty list: nothing) and an LSN range with both ends."""

    tables: tuple[str, ...] | None = None
    low: int | None = None
    high: int | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        if self.low is not None:
            log = log.where(F.col("lsn") >= self.low)
        if self.high is not None:
            log = log.where(F.col("lsn") <= self.high)
        if self.tables is not None:
            log = log.where(is_table(*self.tables))
        return log
