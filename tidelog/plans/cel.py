"""A subset of the Common Expression Language as Spark columns.

Grammar: ``||``, ``&&``, ``!``, comparisons, ``in [..]``, method calls ``startsWith contains endsWith matches size``,
index ``row.m["k"]`` into JSON text, ``timestamp("..")``, literals, parentheses. Names are ``row.f``, ``old.f``, ``op``,
``table`` and ``lsn``. A predicate that is null is false. Unknown names fail when the plan is built. There is no time
limit on a predicate: what it may hold is bounded by its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import RuleInvalid

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[<>!().,\[\]\-]))""")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class _Null:
    """The literal null."""


class Translator:
    """``row`` and ``old`` give columns by field name and raise KeyError for a field that the table lacks."""

    def __init__(self, row: Callable[[str], Column], old: Callable[[str], Column], names: dict[str, Column] | None = None):
        self.row, self.old = row, old
        self.names = names or {"op": F.col("op"), "table": F.concat_ws(".", F.col("table.schema"), F.col("table.table")), "lsn": F.col("lsn")}

    def __call__(self, expression: str) -> Column:
        """The predicate as a column that is true or false."""
        self.tokens, at = [], 0
        text = expression.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise RuleInvalid(f"{expression!r}: not understood at {at}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.place = 0
        result = self._or()
        if self.place != len(self.tokens) or isinstance(result, _Null):
            raise RuleInvalid(f"{expression!r}: more than a predicate")
        return F.coalesce(result, F.lit(False))

    def _peek(self, *ops: str) -> bool:
        return self.place < len(self.tokens) and self.tokens[self.place][0] in ("op", "name") and self.tokens[self.place][1] in ops

    def _take(self, *ops: str) -> str:
        if not self._peek(*ops):
            raise RuleInvalid(f"expected one of {ops} at token {self.place}")
        self.place += 1
        return self.tokens[self.place - 1][1]

    def _or(self):
        left = self._and()
        while self._peek("||"):
            self.place += 1
            left = left | self._and()
        return left

    def _and(self):
        left = self._not()
        while self._peek("&&"):
            self.place += 1
            left = left & self._not()
        return left

    def _not(self):
        if self._peek("!"):
            self.place += 1
            return ~self._not()
        return self._relation()

    def _relation(self):
        left = self._value()
        if self._peek("in"):
            self.place += 1
            self._take("[")
            items = []
            while not self._peek("]"):
                items.append(self._value())
                if self._peek(","):
                    self.place += 1
            self._take("]")
            return left.isin(*items)
        if self._peek(*_COMPARE):
            op = self._take(*_COMPARE)
            right = self._value()
            if isinstance(left, _Null):
                left, right = right, left
            if isinstance(right, _Null):
                if op not in ("==", "!="):
                    raise RuleInvalid("null compares with == and != only")
                return left.isNull() if op == "==" else left.isNotNull()
            return _COMPARE[op](left, right)
        return left

    def _value(self):
        value = self._primary()
        while self._peek(".", "["):
            if self._take(".", "[") == "[":
                kind, key = self.tokens[self.place]
                if kind != "str":
                    raise RuleInvalid("an index is a string")
                self.place += 1
                self._take("]")
                value = F.get_json_object(value, "$." + _unquoted(key))
                continue
            method = self.tokens[self.place][1]
            self.place += 1
            self._take("(")
            argument = None if self._peek(")") else self._value()
            self._take(")")
            calls = {"startsWith": lambda: value.startswith(argument), "endsWith": lambda: value.endswith(argument), "contains": lambda: value.contains(argument), "matches": lambda: F.regexp_like(value, argument), "size": lambda: F.length(value)}
            if method not in calls:
                raise RuleInvalid(f"no method {method}")
            value = calls[method]()
        return value

    def _primary(self):
        if self.place >= len(self.tokens):
            raise RuleInvalid("the predicate ends early")
        kind, token = self.tokens[self.place]
        self.place += 1
        if kind == "num":
            return F.lit(float(token) if "." in token else int(token))
        if kind == "str":
            return F.lit(_unquoted(token))
        if token == "(":
            inner = self._or()
            self._take(")")
            return inner
        if token == "-":
            return -self._primary()
        if token in ("true", "false"):
            return F.lit(token == "true")
        if token == "null":
            return _Null()
        if token == "timestamp":
            self._take("(")
            value = self._value()
            self._take(")")
            return F.to_timestamp(value)
        if token in ("row", "old"):
            self._take(".")
            name = self.tokens[self.place][1]
            self.place += 1
            try:
                return (self.row if token == "row" else self.old)(name)
            except KeyError:
                raise RuleInvalid(f"no column {token}.{name}") from None
        if token in self.names:
            return self.names[token]
        raise RuleInvalid(f"no name {token}")


def _unquoted(token: str) -> str:
    return re.sub(r"\\(.)", r"\1", token[1:-1])


def struct_fields(struct: str, fields: list[str]) -> Callable[[str], Column]:
    """Fields of a typed row; KeyError for any other."""
    known = {f: F.col(f"{struct}.{f}") for f in fields}
    return known.__getitem__
