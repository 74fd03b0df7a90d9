"""Expressions as SQL text.

A line's parser has some thousand nodes. Built with ``pyspark.sql.functions`` each of them costs several round trips to the
JVM (many seconds in all); as one text it is parsed there at once. ``X.length(x)`` writes a call of the SQL function of that
name; ``column`` gives the text to DataFrame code. Strings are literals, columns are named by ``X.col``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 2**31 else str(value)
    if isinstance(value, float):
        return f"double('{value}')" if value in (float("inf"), float("-inf")) else f"{value!r}D".upper()
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def text(value: object) -> str:
    return value.text if isinstance(value, Sql) else literal(value)


#: How tightly an expression binds: parentheses are written only where they are needed, as the parser reads ahead in them.
OR, AND, NOT, COMPARED, BITS, SUM, PRODUCT, WHOLE = range(8)


def inside(value: object, least: int) -> str:
    return f"({value.text})" if isinstance(value, Sql) and value.binds < least else text(value)


class Sql:
    """An expression; its operators write larger ones."""

    __hash__ = None

    def __init__(self, text: str, name: str | None = None, binds: int = WHOLE):
        self.text, self.name, self.binds = text, name, binds

    @property
    def column(self) -> Column:
        return F.expr(self.text) if self.name is None else F.expr(self.text).alias(self.name)

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name, self.binds)

    def cast(self, kind: str) -> Sql:
        return Sql(f"cast({self.text} as {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"try_cast({self.text} as {kind})")

    def __getitem__(self, key: int | str) -> Sql:
        """An array's element by its place from 0 (null beyond its end), or a struct's field."""
        if isinstance(key, int):
            return Sql(f"`get`({self.text}, {key})")
        return Sql(f"{self.text}.`{key}`" if self.binds == WHOLE and not self.text.startswith("case ") else f"({self.text}).`{key}`")

    def isNull(self) -> Sql:
        return Sql(f"`isnull`({self.text})")

    def isNotNull(self) -> Sql:
        return Sql(f"`isnotnull`({self.text})")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"`regexp_like`({self.text}, {literal(pattern)})")

    def startswith(self, other: object) -> Sql:
        return Sql(f"`startswith`({self.text}, {text(other)})")

    def endswith(self, other: object) -> Sql:
        return Sql(f"`endswith`({self.text}, {text(other)})")

    def contains(self, other: object) -> Sql:
        return Sql(f"`contains`({self.text}, {text(other)})")

    def substr(self, start: object, length: object) -> Sql:
        return Sql(f"`substring`({self.text}, {text(start)}, {text(length)})")

    def isin(self, *values: object) -> Sql:
        return Sql(f"{inside(self, BITS)} in ({', '.join(map(text, values))})", binds=COMPARED)

    def between(self, low: object, high: object) -> Sql:
        return (self >= low) & (self <= high)

    def when(self, condition: Sql, value: object) -> Sql:
        return Sql(self.text.removesuffix(" end") + f" when {condition.text} then {text(value)} end")

    def otherwise(self, value: object) -> Sql:
        return Sql(self.text.removesuffix(" end") + f" else {text(value)} end")

    def xor(self, other: object) -> Sql:
        return Sql(f"{inside(self, WHOLE)} ^ {inside(other, WHOLE)}", binds=BITS)

    def bits(self, mask: int) -> Sql:
        return Sql(f"{inside(self, WHOLE)} & {mask}L", binds=BITS)

    def __invert__(self) -> Sql:
        return Sql(f"not {inside(self, COMPARED)}", binds=NOT)

    def __neg__(self) -> Sql:
        return Sql(f"`negative`({self.text})")


def _operator(sign: str, binds: int, turned: bool = False) -> Callable[[Sql, object], Sql]:
    # Operators group to the left, so the right side has to bind more tightly; comparisons don't chain at all.
    left = binds + (binds == COMPARED)

    def write(self: Sql, other: object) -> Sql:
        a, b = (other, self) if turned else (self, other)
        return Sql(f"{inside(a, left)} {sign} {inside(b, binds + 1)}", binds=binds)

    return write


for _name, (_sign, _binds) in {
    "eq": ("=", COMPARED), "ne": ("<>", COMPARED), "lt": ("<", COMPARED), "le": ("<=", COMPARED), "gt": (">", COMPARED), "ge": (">=", COMPARED),
    "add": ("+", SUM), "sub": ("-", SUM), "mul": ("*", PRODUCT), "truediv": ("/", PRODUCT), "mod": ("%", PRODUCT), "and": ("and", AND), "or": ("or", OR),
}.items():
    setattr(Sql, f"__{_name}__", _operator(_sign, _binds))
for _name, (_sign, _binds) in {"radd": ("+", SUM), "rsub": ("-", SUM), "rmul": ("*", PRODUCT)}.items():
    setattr(Sql, f"__{_name}__", _operator(_sign, _binds, turned=True))

_numbers = itertools.count()


def _argument(value: object) -> str:
    if callable(value) and not isinstance(value, Sql):
        count = value.__code__.co_argcount - len(value.__defaults__ or ())
        names = [f"v{next(_numbers)}" for _ in range(count)]
        return f"({', '.join(names)}) -> {text(value(*map(Sql, names)))}" if count > 1 else f"{names[0]} -> {text(value(Sql(names[0])))}"
    return text(value)


class _Functions:
    def __getattr__(self, name: str) -> Callable[..., Sql]:
        # In quotes, since some names (substring, trim) have a grammar of their own, for which the parser reads far ahead.
        return lambda *args: Sql(f"`{name}`({', '.join(map(_argument, args))})")

    def col(self, name: str) -> Sql:
        return Sql(".".join(f"`{part}`" for part in name.split(".")))

    def lit(self, value: object) -> Sql:
        return Sql(literal(value))

    def when(self, condition: Sql, value: object) -> Sql:
        return Sql(f"case when {condition.text} then {text(value)} end")

    def struct(self, *parts: Sql) -> Sql:
        return Sql("named_struct(" + ", ".join(f"{literal(p.name)}, {p.text}" for p in parts) + ")")

    def bind(self, value: Sql, make: Callable[[Sql], Sql]) -> Sql:
        """``make(value)`` with the value computed once, however often ``make`` names it.

        A chain of columns would do so too, but a filter on its end is pushed down as one expression in which every name
        is replaced by what it stands for. An aggregate over nothing hands the value straight on, where a transform of one
        element makes two arrays and a copy each time.
        """
        return self.aggregate(self.array(), value, lambda bound, none: bound, make)


X = _Functions()
