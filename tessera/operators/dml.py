"""INSERT, UPDATE, DELETE and VACUUM on immutable table states."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import nodes as N
from tessera.plans.lexer import SqlError
from tessera.plans.planner import Expressions, Planner, Scope
from tessera.sources.catalog import FILE, Catalog, TableState, spark_type

HIT = "`\x00hit`"


class Violation(SqlError):
    """A constraint that a statement would break."""


class Work:
    """The tables that a statement or transaction sees and changes, before they are published."""

    def __init__(self, catalog: Catalog, planner: Callable[[Work], Planner]):
        self.catalog, self.databases = catalog, dict(catalog.databases)
        self.planner = planner(self)
        self.db: str | None = None
        self.made: list[str] = []  # folders written, to go if the work is given up

    def database(self) -> dict:
        if self.db is None:
            raise SqlError("Database not selected!")
        if self.db not in self.databases:
            raise SqlError(f"Database '{self.db}' does not exist.")
        return self.databases[self.db]

    def table(self, name: str) -> TableState:
        found = self.database().get(name.lower())
        if not found:
            raise SqlError(f"Table '{name}' does not exist.")
        return found

    def put(self, state: TableState) -> None:
        self.databases[self.db] = self.database() | {state.name.lower(): state}

    def drop(self, name: str) -> None:
        self.databases[self.db] = {k: v for k, v in self.database().items() if k != name.lower()}

    def read(self, state: TableState) -> DataFrame:
        return self.catalog.read(state)

    def write(self, state: TableState, df: DataFrame) -> tuple[str, int]:
        part = self.catalog.write(self.db, state, df)
        self.made.append(part[0])
        return part

    def give_up(self) -> None:
        for path in self.made:
            self.catalog.storage.remove(path)

    def children(self, parent: TableState) -> list[tuple[TableState, N.Field]]:
        return [
            (t, f)
            for t in self.database().values()
            for f in t.fields
            if f.references and f.references[0].lower() == parent.name.lower()
        ]


def date_of(text: str) -> datetime.date:
    try:
        return datetime.date.fromisoformat(text[:10])
    except ValueError:
        return datetime.datetime.strptime(text, "%m/%d/%Y").date()


def converted(value, field: N.Field):
    """A value in the type of a field; ValueError if it has none."""
    if value is None:
        return None
    kind = spark_type(field).typeName()
    if kind in ("integer", "long"):
        if isinstance(value, bool) or (isinstance(value, float) and value != int(value)):
            raise ValueError(value)
        out = int(value)
        if abs(out) >= 1 << (31 if kind == "integer" else 63):
            raise ValueError(value)
        return out
    if kind in ("float", "double"):
        if isinstance(value, bool):
            raise ValueError(value)
        return struct.unpack("f", struct.pack("f", float(value)))[0] if kind == "float" else float(value)
    if kind == "boolean":
        if str(value).lower() not in ("true", "false"):
            raise ValueError(value)
        return str(value).lower() == "true"
    if kind == "date":
        return value if isinstance(value, datetime.date) else date_of(str(value))
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return text[: field.length] if field.length else text


def constant(e):
    match e:
        case N.Lit(v):
            return v
        case N.Col():
            return str(e)  # a bare word
        case N.Binary(op, a, b) if op in "+-*/":
            a, b = constant(a), constant(b)
            if a is None or b is None:
                return None
            if op == "+" and (isinstance(a, str) or isinstance(b, str)):
                return f"{a}{b}"
            return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if b else None
    raise SqlError("INSERT takes constants only.")


def held(work: Work, state: TableState, columns: list[str], asked: set[tuple]) -> set[tuple]:
    """Those of the asked key tuples that the table holds: recent rows here, files by a semi join."""
    if not asked:
        return set()
    at = [next(i for i, f in enumerate(state.fields) if f.name.lower() == c.lower()) for c in columns]
    found = {k for k in (tuple(r[i] for i in at) for r in state.recent) if k in asked}
    if state.parts and asked - found:
        found |= work.catalog.look_up(state, columns, asked - found)
    return found


def insert(work: Work, s: N.Statement) -> list[str]:
    state = work.table(s.table)
    columns = list(s.columns) or [f.name for f in state.fields]
    for c in columns:
        if not state.field(c):
            raise SqlError(f"Invalid column name: {c}")
    if any(len(r) != len(columns) for r in s.rows):
        raise SqlError("The number of values doesn't match the number of columns.")
    place = {c.lower(): i for i, c in enumerate(columns)}
    messages, good = [], []
    for n, row in enumerate(s.rows, 1):
        try:
            good.append(
                (
                    n,
                    tuple(
                        converted(constant(row[place[f.name.lower()]]) if f.name.lower() in place else f.default, f)
                        for f in state.fields
                    ),
                ),
            )
        except (ValueError, OverflowError):
            messages.append(f"Type of argument doesn't match with column type in row {n}!")
    at = {f.name: i for i, f in enumerate(state.fields)}
    unique = ([("Primary key", state.keys)] if state.keys else []) + [
        ("Unique key", [f.name])
        for f in state.fields
        if f.unique and not f.primary
    ]
    taken = {
        tuple(names): held(work, state, names, {k for k in (tuple(r[at[c]] for c in names) for _, r in good) if None not in k})
        for _, names in unique
    }
    parents = {}
    for f in state.fields:
        if f.references:
            parents[f.name] = held(
                work,
                work.table(f.references[0]),
                [f.references[1]],
                {(r[at[f.name]],) for _, r in good if r[at[f.name]] is not None},
            )
    rows = []
    for n, row in good:
        problem = None
        for what, names in unique:
            key = tuple(row[at[c]] for c in names)
            if what == "Primary key" and None in key:
                problem = f"Primary key cannot be null in row {n}!"
            elif None not in key and key in taken[tuple(names)]:
                problem = f"{what} violation in row {n}!"
        for f in state.fields:
            value = row[at[f.name]]
            own = f.references and f.references[0].lower() == state.name.lower() and any(
                r[at[state.field(f.references[1]).name]] == value
                for r in [*rows, row]
            )
            if f.references and value is not None and (value,) not in parents[f.name] and not own:
                problem = problem or f"Foreign key violation in row {n}!"
        if problem:
            messages.append(problem)
            continue
        rows.append(row)
        for _, names in unique:
            taken[tuple(names)].add(tuple(row[at[c]] for c in names))
    if rows:
        work.put(work.catalog.appended(work.db, state, rows))
    return [*messages, f"Rows affected: {len(rows)}"]


def bound(work: Work, state: TableState) -> tuple[Callable[[DataFrame], DataFrame], Expressions]:
    """What names a table's columns as expressions do, and the expressions."""
    scope = Scope()
    scope.add(work.catalog.spark.createDataFrame([], state.schema), N.Table(state.name))
    inside = [c.inside for c in scope.columns]
    return lambda df: df.toDF(*inside, *df.columns[len(inside) :]), Expressions(work.planner, scope, {})


def condition(expr: Expressions, where) -> Column:
    return F.coalesce(expr.truth(where), F.lit(False)) if where is not None else F.lit(True)


def fitted(new: Column, kind: str, f: N.Field) -> tuple[Column, Column]:
    """A value in the type of a field, as INSERT would take it, and whether it has none."""
    type_ = spark_type(f)
    kept = new.try_cast(type_)
    if type_.typeName() == "date" and kind == "string":
        kept = F.coalesce(F.try_to_date(F.substring(new, 1, 10), "yyyy-MM-dd"), F.try_to_date(new, "MM/dd/yyyy"))
    if type_.typeName() == "string":
        kept = F.lower(kept) if kind == "boolean" else kept
        kept = F.substring(kept, 1, f.length) if f.length else kept
    lost = kept.isNull()
    if type_.typeName() in ("integer", "long"):
        lost = lost | (kept.cast("double") != new.cast("double") if kind == "numeric" else ~new.cast("string").rlike(r"^\s*[+-]?\d+\s*$"))
    if type_.typeName() in ("float", "double") and kind == "boolean":
        lost = F.lit(True)
    return kept, new.isNotNull() & lost


def update(work: Work, s: N.Statement) -> list[str]:
    """Writes again only the files that hold a row to change."""
    state = work.table(s.table)
    name, expr = bound(work, state)
    hit, sets = condition(expr, s.where), {}
    for column, e in s.sets:
        field = state.field(column)
        if not field:
            raise SqlError(f"Invalid column name: {column}")
        sets[field.name] = fitted(*expr(e), field)
    inside = {c.name: c.inside for c in expr.scope.columns}
    failed = F.lit(False)
    for _, lost in sets.values():
        failed = failed | lost
    out = [
        F.when(F.col(HIT), sets[f.name][0]).otherwise(F.col(f"`{inside[f.name]}`")).alias(f.name) if f.name in sets else F.col(f"`{inside[f.name]}`").alias(f.name)
        for f in state.fields
    ]
    fewer = work.catalog.recent(state)
    marked = name(fewer).withColumn("\x00hit", hit)
    recent = marked.select(*out, "`\x00hit`", (F.col(HIT) & failed).alias("\x00failed")).collect() if state.recent else []
    n, broken, touched, stored = sum(r[-2] for r in recent), any(r[-1] for r in recent), set(), None
    if state.parts:
        stored = name(work.catalog.files(state, named=True)).withColumn("\x00hit", hit)
        counts = stored.filter(HIT).groupBy(f"`{FILE}`").agg(F.count("*"), F.count_if(failed)).collect()
        touched, n, broken = {r[0] for r in counts}, n + sum(r[1] for r in counts), broken or any(r[2] for r in counts)
    if broken:
        raise SqlError("Type of argument doesn't match with column type.")
    if not n:
        return ["Rows affected: 0"]
    after = replace(state, recent=tuple(tuple(r)[:-2] for r in recent))
    changed = work.catalog.spark.createDataFrame([tuple(r)[:-2] for r in recent if r[-2]], state.schema)
    if touched:
        again = stored.filter(F.col(f"`{FILE}`").isin(*touched))
        after = replace(after, parts=(*work.catalog.without(state, touched), work.write(state, again.select(*out))))
        changed = changed.union(stored.filter(HIT).select(*out))
    check_update(work, state, after, set(sets), changed)
    work.put(after)
    return [f"Rows affected: {n}"]


def check_update(work: Work, before: TableState, after: TableState, names: set[str], changed: DataFrame) -> None:
    """Checks the keys of the changed rows; a key that no changed row holds is as it was."""
    new = work.read(after)

    def twice(columns: list[str]) -> bool:
        keys = changed.select(*[F.col(f"`{c}`") for c in columns]).dropna().distinct()
        return not new.join(keys, columns, "left_semi").groupBy(*[F.col(f"`{c}`") for c in columns]).count().filter("count > 1").isEmpty()

    if names & set(before.keys):
        if not changed.filter(" or ".join(f"`{k}` is null" for k in before.keys)).isEmpty():
            raise Violation("Constraint violation: Primary key cannot be null.")
        if twice(before.keys):
            raise Violation("Constraint violation: Primary key violation.")
    for f in before.fields:
        if f.name not in names:
            continue
        if f.unique and not f.primary and twice([f.name]):
            raise Violation(f"Constraint violation: Unique key violation on {f.name}.")
        if f.references:
            parent = after if f.references[0].lower() == before.name.lower() else work.table(f.references[0])
            known = work.read(parent).select(F.col(f"`{f.references[1]}`").alias(f.name))
            if not changed.select(f"`{f.name}`").dropna().join(known, f.name, "left_anti").isEmpty():
                raise Violation(f"Constraint violation: Foreign key violation on {f.name}.")
    for child, f in work.children(before):
        column = before.field(f.references[1]).name
        if column in names:
            gone = work.read(before).select(F.col(f"`{column}`").alias("k")).distinct().join(
                new.select(F.col(f"`{column}`").alias("k")),
                "k",
                "left_anti",
            )
            child_rows = work.read(after if child.name == before.name else child)
            if not child_rows.select(F.col(f"`{f.name}`").alias("k")).join(gone, "k", "left_semi").isEmpty():
                raise Violation(f"Foreign key violation: Cannot update {before.name}.{column}, it is referenced by {child.name}.")


def taken_out(
    work: Work,
    state: TableState,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
) -> tuple[TableState, DataFrame, int]:
    """state without the rows that split puts first, those rows and how many; only files that hold one are written again."""
    fields = [F.col(f"`{f.name}`") for f in state.fields]
    doomed, rest = split(work.catalog.recent(state))
    left = [tuple(r) for r in rest.select(*fields).collect()] if state.recent else []
    n, out = len(state.recent) - len(left), replace(state, recent=tuple(left))
    doomed = doomed.select(*fields)
    if state.parts:
        stored = work.catalog.files(state, named=True)
        hits = split(stored)[0]
        counts = hits.groupBy(f"`{FILE}`").count().collect()
        doomed, n = doomed.union(hits.select(*fields)), n + sum(r[1] for r in counts)
        touched = {r[0] for r in counts}
        if touched:
            rest = split(stored.filter(F.col(f"`{FILE}`").isin(*touched)))[1].select(*fields)
            parts = work.catalog.without(state, touched)
            # a file may lose all its rows
            out = replace(out, parts=parts if rest.isEmpty() else (*parts, work.write(state, rest)))
    return out, doomed, n


def delete(work: Work, s: N.Statement) -> list[str]:
    state = work.table(s.table)
    name, expr = bound(work, state)
    hit, plain = condition(expr, s.where), [f.name for f in state.fields]

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        marked = name(df).withColumn("\x00hit", hit).toDF(*plain, *df.columns[len(plain) :], "\x00hit")
        return marked.filter(HIT).drop("\x00hit"), marked.filter(~F.col(HIT)).drop("\x00hit")

    after, doomed, n = taken_out(work, state, split)
    if n:
        remove(work, state, after, doomed)
    return [f"Rows affected: {n}"]


def remove(work: Work, before: TableState, after: TableState, doomed: DataFrame) -> None:
    """Puts a table that has lost the doomed rows, after rows that hold their keys have gone too or forbidden it."""

    def holding(column: str, key: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
        keys = doomed.select(F.col(f"`{key}`").alias(column)).dropna().distinct()
        return lambda df: tuple(
            df.join(keys, column, how).select(*[F.col(f"`{c}`") for c in df.columns])
            for how in ("left_semi", "left_anti")
        )

    for f in [f for t, f in work.children(before) if t.name == before.name]:
        while True:
            after, more, n = taken_out(work, after, holding(f.name, f.references[1]))
            if not n:
                break
            if f.references[2] != "CASCADE":
                raise Violation(f"Foreign key violation: rows of {before.name} are referenced by {before.name}.")
            doomed = doomed.union(more)
    work.put(after)
    for child, f in work.children(before):
        if child.name == before.name:
            continue
        child = work.table(child.name)
        left, gone, n = taken_out(work, child, holding(f.name, f.references[1]))
        if n and f.references[2] != "CASCADE":
            raise Violation(f"Foreign key violation: rows of {before.name} are referenced by {child.name}.")
        if n:
            remove(work, child, left, gone)


def vacuum(work: Work, s: N.Statement) -> list[str]:
    state = work.table(s.table)
    df = work.read(state)
    n = df.count()
    work.put(work.catalog.stored(work.db, state, df))
    return [f"VACUUM complete. {n} rows compacted in {state.name}."]
