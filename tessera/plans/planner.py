"""From the syntax tree to one lazy DataFrame; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.registry import AGGREGATES, SCALARS, aggregate
from tessera.operators.setops import union
from tessera.plans import nodes as N
from tessera.plans.lexer import BindingError, SqlError


@dataclass(frozen=True)
class Bound:
    """A column of the FROM clause: where it comes from and its name inside the plan."""

    table: str
    name: str
    inside: str
    type: T.DataType

    @property
    def column(self) -> Column:
        return F.col(f"`{self.inside}`")


class Scope:
    def __init__(self, outer: Scope | None = None):
        self.columns: list[Bound] = []
        self.names: dict[str, str] = {}  # physical name -> alias, where unambiguous
        self.outer = outer

    def add(self, df: DataFrame, table: N.Table) -> DataFrame:
        alias = table.alias or table.name
        if any(c.table.lower() == alias.lower() for c in self.columns):
            raise BindingError(f"table or alias '{alias}' is used twice")
        self.names[table.name.lower()] = "" if table.name.lower() in self.names else alias
        own = [Bound(alias, f.name, f"{alias}.{f.name}", f.dataType) for f in df.schema]
        self.columns += own
        return df.toDF(*[c.inside for c in own])

    def match(self, col: N.Col) -> list[Bound]:
        name, table = col.name.lower(), col.table and col.table.lower()
        found = [c for c in self.columns if c.name.lower() == name and table in (None, c.table.lower())]
        if not found and table and self.names.get(table):
            found = [c for c in self.columns if c.name.lower() == name and c.table == self.names[table]]
        return found

    def find(self, col: N.Col) -> Bound:
        found = self.match(col)
        if len(found) > 1:
            raise BindingError(f"column '{col}' is ambiguous")
        if found:
            return found[0]
        above = self.outer
        while above:
            if above.match(col):
                raise SqlError("Correlated subqueries are not supported yet.")
            above = above.outer
        raise BindingError(f"Invalid column name: {col}")


STRING, NUMBER, BOOLEAN, DATE, NOTHING = "string", "numeric", "boolean", "date", "null"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType):
        return DATE
    return NOTHING if isinstance(t, T.NullType) else NUMBER if isinstance(t, T.NumericType) else str(t)


class Expressions:
    """Columns for expressions in a scope; `known` holds what an aggregation has computed before."""

    def __init__(self, planner: Planner, scope: Scope, ctes: dict, known: dict | None = None, inner: Callable | None = None):
        self.planner, self.scope, self.ctes, self.known, self.inner = planner, scope, ctes, known or {}, inner

    def __call__(self, e) -> tuple[Column, str]:
        if e in self.known:
            return self.known[e]
        match e:
            case N.Lit(v):
                kind = BOOLEAN if isinstance(v, bool) else NUMBER if isinstance(v, int | float) else STRING if isinstance(v, str) else NOTHING if v is None else DATE
                return F.lit(v), kind
            case N.Col():
                bound = self.scope.find(e)
                return (self.inner(bound) if self.inner else bound.column), kind_of(bound.type)
            case N.Binary(op, a, b) if op in ("AND", "OR"):
                left, right = self.truth(a), self.truth(b)
                return (left & right if op == "AND" else left | right), BOOLEAN
            case N.Binary(op, a, b) if op in ("=", "!=", "<", "<=", ">", ">="):
                left, right = self.pair(a, b)
                return {
                    "=": left == right,
                    "!=": left != right,
                    "<": left < right,
                    "<=": left <= right,
                    ">": left > right,
                    ">=": left >= right,
                }[op], BOOLEAN
            case N.Binary(op, a, b):
                (left, lk), (right, rk) = self(a), self(b)
                if op == "+" and STRING in (lk, rk):
                    return F.concat(left.cast("string"), right.cast("string")), STRING
                if STRING in (lk, rk) or BOOLEAN in (lk, rk):
                    raise BindingError(f"operator '{op}' needs numbers")
                if op == "/":
                    return F.try_divide(left.cast("double"), right.cast("double")), NUMBER
                return {"+": left + right, "-": left - right, "*": left * right}[op], NUMBER
            case N.Not(of):
                return ~self.truth(of), BOOLEAN
            case N.IsNull(of):
                return self(of)[0].isNull(), BOOLEAN
            case N.Like(of, N.Lit(str(text))):
                return self(of)[0].cast("string").like(text.replace("\\", "\\\\")), BOOLEAN
            case N.Like(of, pattern):
                return F.like(self(of)[0].cast("string"), self(pattern)[0].cast("string")), BOOLEAN
            case N.In(of, items, None):
                if all(isinstance(x, N.Lit) for x in items):
                    return self(of)[0].isin(*[self.fit(of, x) for x in items]), BOOLEAN
                out = F.lit(False)
                for x in items:
                    left, right = self.pair(of, x)
                    out = out | (left == right)
                return out, BOOLEAN
            case N.In(of, _, query):
                sub = self.planner.plan(query, self.ctes, self.scope)
                if len(sub.columns) != 1:
                    raise SqlError("A subquery of IN must return exactly one column.")
                own, kind = self(of)
                if kind_of(sub.schema[0].dataType) != kind and NOTHING not in (kind, kind_of(sub.schema[0].dataType)):
                    sub = sub.select(F.col(f"`{sub.columns[0]}`").cast("string"))
                    own = own.cast("string")
                return own.isin(sub), BOOLEAN
            case N.Between(of, low, high):
                return self(N.Binary("AND", N.Binary(">=", of, low), N.Binary("<=", of, high)))[0], BOOLEAN
            case N.Exists(query):
                return self.planner.plan(query, self.ctes, self.scope).exists(), BOOLEAN
            case N.Scalar(query):
                sub = self.planner.plan(query, self.ctes, self.scope)
                if len(sub.columns) != 1:
                    raise SqlError("A scalar subquery must return exactly one column.")
                if self.planner.eager and len(sub.limit(2).collect()) > 1:
                    raise SqlError("A scalar subquery returned more than one row.")
                return sub.scalar(), kind_of(sub.schema[0].dataType)
            case N.Call(name, of, _) if name in SCALARS:
                return SCALARS[name](self(of)[0].cast("string")), NUMBER if name.startswith("LEN") else STRING
            case N.Call():
                raise BindingError(f"aggregate {header(e)} is not allowed here")
            case N.Rank():
                raise BindingError("RANK() is only allowed in the SELECT list")
        raise BindingError(f"unsupported expression {e}")

    def truth(self, e) -> Column:
        column, kind = self(e)
        if kind == NUMBER:
            return column != 0
        return F.lower(column) == "true" if kind == STRING else column

    def pair(self, a, b) -> tuple[Column, Column]:
        """Both sides of a comparison; a literal takes the type of the other side, so that filters reach the scan."""
        (left, lk), (right, rk) = self(a), self(b)
        if lk == rk or NOTHING in (lk, rk):
            return left, right
        if isinstance(b, N.Lit):
            return left, F.lit(self.fit(a, b)) if not isinstance(self.fit(a, b), Column) else self.fit(a, b)
        if isinstance(a, N.Lit):
            return (F.lit(self.fit(b, a)) if not isinstance(self.fit(b, a), Column) else self.fit(b, a)), right
        return left.cast("string"), right.cast("string")

    def fit(self, of, lit: N.Lit):
        kind = self(of)[1]
        if kind == DATE and isinstance(lit.value, str):
            return F.coalesce(
                F.try_to_date(F.lit(lit.value), "yyyy-MM-dd"),
                F.try_to_date(F.lit(lit.value), "MM/dd/yyyy"),
                F.lit(lit.value).try_cast("timestamp").cast("date"),
            )
        if kind == NUMBER and isinstance(lit.value, str):
            try:
                return float(lit.value)
            except ValueError:
                return None
        if kind == STRING and lit.value is not None and not isinstance(lit.value, str):
            return str(lit.value).lower() if isinstance(lit.value, bool) else str(lit.value)
        if kind == BOOLEAN and isinstance(lit.value, str | int | float) and not isinstance(lit.value, bool):
            return {"true": True, "false": False, "1": True, "0": False}.get(str(lit.value).lower())
        return lit.value


def header(e) -> str:
    """The name of a result column without an alias."""
    match e:
        case N.Call(name, of, distinct):
            return f"{name}({'DISTINCT ' * distinct}{'*' if of is None else header(of)})"
        case N.Col():
            return str(e)
        case N.Lit(v):
            return "NULL" if v is None else str(v)
        case N.Binary(op, a, b):
            return f"{header(a)} {op} {header(b)}"
        case N.Rank():
            return "RANK()"
    return type(e).__name__.lower()


class Planner:
    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], eager: bool = False):
        self.spark, self.table, self.eager = spark, table, eager

    def plan(self, query, ctes: dict | None = None, outer: Scope | None = None) -> DataFrame:
        ctes = dict(ctes or {})
        if isinstance(query, N.Union):
            return self.compound(query, ctes, outer)
        for name, body in query.ctes:
            ctes[name.lower()] = self.plan(body, ctes, outer)
        return self.select(query, ctes, outer)

    def compound(self, q: N.Union, ctes: dict, outer: Scope | None) -> DataFrame:
        out = None
        for branch, every in zip(q.branches, (True, *q.alls), strict=True):
            part = self.plan(branch, ctes, outer)
            out = part if out is None else union(out, part, every, kind_of)
        keys = []
        for e, descending in q.order:
            name = next((c for c in out.columns if isinstance(e, N.Col) and c.lower() == str(e).lower()), None)
            if name is None:
                raise BindingError(f"Invalid column name: {header(e)}")
            keys.append(F.col(f"`{name}`").desc() if descending else F.col(f"`{name}`").asc())
        return self.cut(out.orderBy(*keys) if keys else out, q)

    def cut(self, df: DataFrame, q) -> DataFrame:
        if q.offset:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)

    def source(self, t: N.Table, ctes: dict) -> DataFrame:
        return ctes[t.name.lower()] if t.name.lower() in ctes else self.table(t.name)

    def select(self, q: N.Select, ctes: dict, outer: Scope | None) -> DataFrame:
        scope = Scope(outer)
        df = scope.add(self.source(q.table, ctes), q.table) if q.table else self.spark.range(1).select()
        for j in q.joins:
            df = self.joined(df, scope, j, ctes)
        items = self.spread(q.items, scope, bool(q.joins))
        expr = Expressions(self, scope, ctes)
        if q.where is not None:
            if any(True for _ in N.every(q.where, N.Call) if _.name in AGGREGATES):
                raise BindingError("aggregates are not allowed in WHERE")
            df = df.filter(expr.truth(q.where))
        aliases = {i.alias.lower(): i.expr for i in items if i.alias}
        order = [(aliases.get(str(e).lower(), e) if isinstance(e, N.Col) else e, d) for e, d in q.order]
        having = self.by_alias(q.having, aliases, scope)
        calls = dict.fromkeys(
            c
            for e in [*[i.expr for i in items], having, *[e for e, _ in order]]
            if e is not None
            for c in N.every(e, N.Call)
            if c.name in AGGREGATES
        )
        if calls or q.group:
            df, expr = self.grouped(df, scope, ctes, q.group, list(calls), [*[i.expr for i in items], having, *[e for e, _ in order]])
        if having is not None:
            df = df.filter(expr.truth(having))
        return self.projected(df, q, items, order, expr)

    def by_alias(self, e, aliases: dict, scope: Scope):
        """HAVING may name an alias of the SELECT list."""
        if isinstance(e, N.Col) and e.table is None and e.name.lower() in aliases and not scope.match(e):
            return aliases[e.name.lower()]
        return N.rebuilt(e, lambda x: self.by_alias(x, aliases, scope))

    def joined(self, df: DataFrame, scope: Scope, j: N.Join, ctes: dict) -> DataFrame:
        before = len(scope.columns)
        right = scope.add(self.source(j.table, ctes), j.table)
        if j.how == "cross":
            return df.crossJoin(right)
        one, two = scope.find(j.left), scope.find(j.right)
        new = {c.inside for c in scope.columns[before:]}
        if (one.inside in new) == (two.inside in new):
            raise BindingError(f"ON {j.left} = {j.right} must compare the joined table with one before it")
        left, right_column = one.column, two.column
        if kind_of(one.type) != kind_of(two.type):
            left, right_column = left.cast("string"), right_column.cast("string")
        return df.join(right, left == right_column, {"inner": "inner", "left": "left", "right": "right", "full": "full"}[j.how])

    def spread(self, items: tuple, scope: Scope, dotted: bool) -> list[N.Item]:
        """Stars become columns; each item gets the name of its result column as alias or header."""
        out = []
        for item in items:
            if not isinstance(item.expr, N.Star):
                out.append(item)
                continue
            table = item.expr.table
            names = {table.lower(), scope.names.get(table.lower(), table).lower()} if table else None
            own = [c for c in scope.columns if names is None or c.table.lower() in names]
            if not own:
                raise BindingError(f"unknown table '{table}'" if table else "nothing to select")
            out += [N.Item(N.Col(c.name, c.table)) for c in own]
        return out

    def grouped(self, df, scope, ctes, group, calls, used) -> tuple[DataFrame, Expressions]:
        plain = Expressions(self, scope, ctes)
        keys = list(dict.fromkeys(scope.find(c).inside for c in group))
        known, columns = {}, []
        for i, call in enumerate(calls):
            column, kind = plain(call.of) if call.of is not None else (None, NUMBER)
            if call.name in ("SUM", "AVG") and kind not in (NUMBER, NOTHING):
                raise BindingError(f"{call.name} needs a numeric argument")
            columns.append(aggregate(call.name, column, call.distinct).alias(f"\x00{i}"))
            known[call] = F.col(f"`\x00{i}`"), kind if call.name in ("MIN", "MAX") else NUMBER
        inside = set()
        for e in filter(None, used):
            inside |= {scope.find(c).inside for c in outside(e)}
        for name in sorted(inside - set(keys)):
            columns.append(F.first(F.col(f"`{name}`")).alias(name))
        if not columns:
            return df.select(*[F.col(f"`{k}`") for k in keys]).distinct(), Expressions(self, scope, ctes, known)
        return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*columns), Expressions(self, scope, ctes, known)

    def projected(self, df: DataFrame, q: N.Select, items: list, order: list, expr: Expressions) -> DataFrame:
        out, names, dotted = [], [], bool(q.joins)
        for item in items:
            if isinstance(item.expr, N.Rank):
                r = item.expr
                over = Window.partitionBy(*[expr(c)[0] for c in r.partition]).orderBy(
                    expr(r.order)[0].desc() if r.descending else expr(r.order)[0].asc(),
                )
                column = F.rank().over(over).cast("bigint")
            else:
                column = expr(item.expr)[0]
            name = item.alias
            if name is None and isinstance(item.expr, N.Col):
                bound = expr.scope.find(item.expr)
                name = f"{bound.table}.{bound.name}" if dotted else bound.name
            out.append(column)
            names.append(name or header(item.expr))
        shown = [f"\x01{i}" for i in range(len(out))]
        hidden, keys = [], []
        for i, (e, descending) in enumerate(order):
            if isinstance(e, N.Lit):
                raise BindingError("ORDER BY needs a column or an expression, not a constant")
            at = next(
                (
                    k
                    for k, item in enumerate(items)
                    if item.expr == e or (
                        isinstance(e, N.Col) and isinstance(item.expr, N.Col) and expr.scope.match(e) and expr.scope.match(e) == expr.scope.match(item.expr)
                    )
                ),
                None,
            )
            if at is None:
                if q.distinct:
                    raise BindingError("with DISTINCT, ORDER BY must name items of the SELECT list")
                hidden.append(expr(e)[0].alias(f"\x02{i}"))
            key = F.col(f"`\x02{i}`" if at is None else f"`{shown[at]}`")
            keys.append(key.desc() if descending else key.asc())
        df = df.select(*[c.alias(n) for c, n in zip(out, shown, strict=True)], *hidden)
        if q.distinct:
            df = df.distinct()
        if keys:
            df = df.orderBy(*keys)
        df = self.cut(df, q)
        return df.select(*[F.col(f"`{n}`") for n in shown]).toDF(*names)


def outside(e):
    """Columns of an expression that are not inside an aggregate."""
    if isinstance(e, N.Call) and e.name in AGGREGATES:
        return
    if isinstance(e, N.Col):
        yield e
    for x in N.children(e):
        yield from outside(x)
