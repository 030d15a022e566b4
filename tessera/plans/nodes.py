"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class IsNull:
    of: Any


@dataclass(frozen=True)
class Like:
    of: Any
    pattern: Any


@dataclass(frozen=True)
class In:
    of: Any
    items: tuple = ()
    query: Any = None


@dataclass(frozen=True)
class Between:
    of: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class Scalar:
    query: Any


@dataclass(frozen=True)
class Call:
    name: str
    of: Any  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Rank:
    partition: tuple
    order: Any
    descending: bool


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    how: str
    table: Table
    left: Col | None = None
    right: Col | None = None


@dataclass(frozen=True)
class Select:
    items: tuple
    table: Table | None = None
    joins: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple = ()  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    ctes: tuple = ()  # (name, query)


@dataclass(frozen=True)
class Union:
    branches: tuple
    alls: tuple  # for each branch after the first, whether UNION ALL
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    length: int = 0
    default: Any = None
    has_default: bool = False
    primary: bool = False
    unique: bool = False
    references: tuple | None = None  # (table, column, on delete)
    since: int = 0  # the table's layout in which the column came
    stored: str = ""  # its name in files, if not its own

    @property
    def inside(self) -> str:
        return self.stored or self.name


@dataclass(frozen=True)
class Statement:
    """Any statement that is no query: a kind and its parts."""

    kind: str
    parts: dict = field(default_factory=dict, hash=False)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["parts"][name]
        except KeyError:
            raise AttributeError(name) from None


def children(node: Any):
    """The expressions right under an expression; queries inside are not entered."""
    match node:
        case Binary(_, a, b):
            yield from (a, b)
        case Not(a) | IsNull(a) | In(a, (), _):
            yield a
        case Like(a, b):
            yield from (a, b)
        case In(a, items, _):
            yield from (a, *items)
        case Between(a, b, c):
            yield from (a, b, c)
        case Call(_, a, _) if a is not None:
            yield a
        case Rank(p, o, _):
            yield from (*p, o)


def rebuilt(node: Any, change) -> Any:
    """An expression with each of the expressions right under it changed; queries inside are not entered."""
    match node:
        case Binary(op, a, b):
            return Binary(op, change(a), change(b))
        case Not(a):
            return Not(change(a))
        case IsNull(a):
            return IsNull(change(a))
        case Like(a, b):
            return Like(change(a), change(b))
        case In(a, items, query):
            return In(change(a), tuple(map(change, items)), query)
        case Between(a, b, c):
            return Between(change(a), change(b), change(c))
        case Call(name, a, distinct) if a is not None:
            return Call(name, change(a), distinct)
    return node


def every(node: Any, kind: type):
    if isinstance(node, kind):
        yield node
    for x in children(node):
        yield from every(x, kind)
