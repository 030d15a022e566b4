"""A PEP 249 style front: connections, cursors, parameters, transactions."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

from tessera.plans.lexer import SqlError
from tessera.session import Result, Session

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = SqlError


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.results, self.at, self.rowcount = connection, [], -1, -1
        self.iterator = iter(())

    def execute(self, sql: str, params: Any = None) -> Cursor:
        self.results = self.connection.session.execute(sql, params)
        for r in self.results:
            if r.is_error:
                raise Error("; ".join(r.messages), r.line, r.column)
        counts = [int(m[1]) for r in self.results for text in r.messages if (m := re.search(r"Rows affected: (\d+)", text))]
        self.rowcount = sum(counts) if counts else -1
        self.at = -1
        self.nextset()
        return self

    def executemany(self, sql: str, rows: list) -> Cursor:
        total = 0
        for params in rows:
            self.execute(sql, params)
            total += max(self.rowcount, 0)
        self.rowcount = total
        return self

    def nextset(self) -> bool:
        """On to the next statement that gave rows."""
        self.at += 1
        while self.at < len(self.results) and self.results[self.at].df is None:
            self.at += 1
        self.iterator = iter(())
        if self.at >= len(self.results):
            return False
        self.iterator = self.current.tuples()
        return True

    @property
    def current(self) -> Result | None:
        return self.results[self.at] if 0 <= self.at < len(self.results) else None

    @property
    def description(self):
        if self.current is None:
            return None
        return [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in self.current.df.schema]

    def scalar(self):
        """The first column of the next row; None if there is none."""
        row = self.fetchone()
        return row[0] if row else None

    def fetchone(self):
        return next(self.iterator, None)

    def fetchmany(self, size: int | None = None) -> list:
        return [r for _, r in zip(range(size or self.arraysize), self.iterator, strict=False)]

    def fetchall(self) -> list:
        return list(self.iterator)

    def fetchdict(self) -> dict | None:
        """The next row by column name; an unknown name is a KeyError."""
        row = self.fetchone()
        return None if row is None else dict(zip(self.current.fields, row, strict=True))

    def __iter__(self):
        return self.iterator

    def close(self) -> None:
        self.results, self.iterator = [], iter(())


class Connection:
    def __init__(self, session: Session):
        self.session = session

    def cursor(self) -> Cursor:
        return Cursor(self)

    def begin(self) -> None:
        self.cursor().execute("BEGIN")

    def commit(self) -> None:
        if self.session.transaction:
            self.session.commit()

    def rollback(self) -> None:
        if self.session.transaction:
            self.session.rollback()

    def close(self) -> None:
        self.rollback()
        self.session.close()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.commit() if kind is None else self.rollback()


def connect(spark: SparkSession, root: str | None = None, database: str = "main") -> Connection:
    """Opens (and makes, if need be) a database in a folder, or in a temporary one."""
    session = Session(spark, root)
    session.execute(f"CREATE DATABASE IF NOT EXISTS {database}; USE {database}")
    return Connection(session)
