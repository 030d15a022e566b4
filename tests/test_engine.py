"""The dialect end to end: queries against the oracle, changes, definitions, transactions, errors."""

import datetime
import threading
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tessera import queries as Q
from tessera.dbapi import connect
from tessera.plans.lexer import SqlError
from tessera.session import Session

SF = "/root/testdata/sf0.01"


@pytest.fixture(params=["memory", "disk"])
def db(spark, tmp_path, request):
    s = Session(spark, str(tmp_path / "root") if request.param == "disk" else None)
    s.execute("CREATE DATABASE d; USE d")
    yield s
    s.close()


def ok(s, sql, params=None):
    out = s.execute(sql, params)
    assert not any(r.is_error for r in out), [r.messages for r in out]
    return out[-1]


def rows(s, sql):
    return [tuple(r) for r in s.sql(sql).collect()]


def said(s, sql, text, error=None):
    r = s.execute(sql)[-1]
    assert any(text in m for m in r.messages), r.messages
    assert error is None or r.is_error == error


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(r):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in r)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_oracle(spark, con, name):
    got, want = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert Counter(rounded(r[c] for c in order) for r in got.collect()) == Counter(map(rounded, want.select(*order).fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_insert(db):
    ok(db, "CREATE TABLE p (Id INT PRIMARY KEY, Name VARCHAR(3), Price FLOAT, Day DATE, Ok BIT DEFAULT true, N INT DEFAULT 5)")
    assert ok(
        db,
        "INSERT INTO p (Id, Name, Price, Day) VALUES (1, 'it''s', 1.5, '2024-02-03'), (2, 'b', 0.1, '02/04/2024')",
    ).messages == ["Rows affected: 2"]
    assert rows(db, "SELECT Id, Name, Day, Ok, N FROM p ORDER BY Id") == [
        (1, "it'", datetime.date(2024, 2, 3), True, 5),
        (2, "b", datetime.date(2024, 2, 4), True, 5),
    ]
    r = ok(db, "INSERT INTO p (Id, N) VALUES (1, 1), (3, NULL), (3, 2), (NULL, 1), ('x', 1)")
    assert r.messages[-1] == "Rows affected: 1" and sum("Primary key violation" in m for m in r.messages) == 2
    assert any("Primary key cannot be null" in m for m in r.messages) and any(
        "doesn't match with column type in row 5" in m
        for m in r.messages
    )
    assert rows(db, "SELECT N FROM p WHERE Id = 3") == [(None,)]
    assert rows(db, "SELECT Id FROM p WHERE Day = '2024-02-04'") == [(2,)] and rows(
        db,
        "SELECT Id FROM p WHERE Ok = true AND Name != 'b'",
    ) == [(1,)]
    said(db, "INSERT INTO p (Id, N) VALUES (9)", "number of values", True)


def test_composite_and_foreign_keys(db):
    ok(db, "CREATE TABLE e (S INT PRIMARY KEY, C INT PRIMARY KEY, G VARCHAR)")
    ok(db, "INSERT INTO e VALUES (1, 1, 'a'), (1, 2, 'b'), (2, 1, 'c')")
    said(db, "INSERT INTO e VALUES (1, 2, 'z')", "Primary key violation", False)
    assert rows(db, "SELECT G FROM e WHERE S = 1 ORDER BY C") == [("a",), ("b",)]
    ok(
        db,
        "CREATE TABLE dep (Id INT PRIMARY KEY); CREATE TABLE emp (Id INT PRIMARY KEY, D INT REFERENCES dep(Id), E VARCHAR UNIQUE); INSERT INTO dep VALUES (1), (2)",
    )
    said(db, "INSERT INTO emp VALUES (1, 9, 'a')", "Foreign key violation", False)
    ok(db, "INSERT INTO emp VALUES (1, 1, 'a'), (2, NULL, NULL), (3, NULL, NULL)")
    said(db, "INSERT INTO emp VALUES (4, 1, 'a')", "Unique key violation", False)
    said(db, "DELETE FROM dep WHERE Id = 1", "Foreign key violation", False)
    said(db, "UPDATE dep SET Id = 7 WHERE Id = 1", "Foreign key violation: Cannot update", False)
    said(db, "UPDATE emp SET D = 5 WHERE Id = 1", "Constraint violation", False)
    said(db, "UPDATE emp SET E = 'a'", "Constraint violation", False)
    ok(db, "DELETE FROM dep WHERE Id = 2")
    assert rows(db, "SELECT Id FROM dep") == [(1,)]


def test_cascade(db):
    ok(
        db,
        "CREATE TABLE a (Id INT PRIMARY KEY); CREATE TABLE b (Id INT PRIMARY KEY, A INT REFERENCES a(Id) ON DELETE CASCADE); CREATE TABLE c (Id INT PRIMARY KEY, B INT, FOREIGN KEY (B) REFERENCES b(Id) ON DELETE CASCADE)",
    )
    ok(db, "INSERT INTO a VALUES (1), (2); INSERT INTO b VALUES (10, 1), (20, 2); INSERT INTO c VALUES (100, 10), (200, 20), (300, NULL)")
    assert ok(db, "DELETE FROM a WHERE Id = 1").messages == ["Rows affected: 1"]
    assert rows(db, "SELECT Id FROM b") == [(20,)] and sorted(rows(db, "SELECT Id FROM c")) == [(200,), (300,)]
    ok(
        db,
        "CREATE TABLE n (Id INT PRIMARY KEY, Up INT REFERENCES n(Id) ON DELETE CASCADE); INSERT INTO n VALUES (1, NULL), (2, 1), (3, 2), (4, NULL); DELETE FROM n WHERE Id = 1",
    )
    assert rows(db, "SELECT Id FROM n") == [(4,)]


def test_update(db):
    ok(db, "CREATE TABLE i (Id INT PRIMARY KEY, Cat VARCHAR(4), N INT); INSERT INTO i VALUES (1, 'a', 1), (2, 'a', 2), (3, 'b', NULL)")
    assert ok(db, "UPDATE i SET N = N + 10, Cat = 'longer' WHERE Cat = 'a'").messages == ["Rows affected: 2"]
    assert rows(db, "SELECT * FROM i ORDER BY Id") == [(1, "long", 11), (2, "long", 12), (3, "b", None)]
    ok(db, "UPDATE i SET N = (SELECT MAX(N) FROM i) WHERE N IS NULL")
    assert rows(db, "SELECT N FROM i WHERE Id = 3") == [(12,)]
    said(db, "UPDATE i SET N = 'text'", "doesn't match", True)
    said(db, "UPDATE i SET Id = 1", "Constraint violation", False)
    said(db, "UPDATE i SET Id = NULL WHERE Id = 1", "cannot be null", False)
    assert ok(db, "DELETE FROM i").messages == ["Rows affected: 3"] and rows(db, "SELECT * FROM i") == []


def test_null_semantics(db):
    ok(db, "CREATE TABLE f (Id INT, V INT); INSERT INTO f VALUES (1, NULL), (2, 10), (3, 20)")
    assert rows(db, "SELECT Id FROM f WHERE V = NULL") == [] and rows(db, "SELECT Id FROM f WHERE V != 10") == [(3,)]
    assert rows(db, "SELECT Id FROM f WHERE V IS NULL") == [(1,)] and rows(db, "SELECT V FROM f ORDER BY V") == [(None,), (10,), (20,)]
    assert rows(db, "SELECT V FROM f ORDER BY V DESC") == [(20,), (10,), (None,)]
    assert rows(db, "SELECT Id FROM f WHERE V IN (SELECT V FROM f WHERE V < 15)") == [(2,)]
    assert rows(db, "SELECT SUM(V) AS s, COUNT(V) AS c, COUNT(*) AS n FROM f WHERE V IS NULL") == [(None, 0, 1)]


def test_names_and_errors(db):
    ok(
        db,
        "CREATE TABLE Dep (DepId INT, Name VARCHAR); CREATE TABLE Emp (EmpId INT, Name VARCHAR, DepId INT); INSERT INTO Dep VALUES (1, 'x'); INSERT INTO Emp VALUES (1, 'Ann', 1), (2, 'Bob', 3)",
    )
    r = ok(db, "SELECT Emp.Name, Dep.Name FROM Emp JOIN Dep ON Emp.DepId = Dep.DepId")
    assert r.rows == [{"Emp.Name": "Ann", "Dep.Name": "x"}] and r.messages == ["Rows selected: 1"]
    assert db.sql("SELECT COUNT(*), MAX(DepId) FROM Emp").columns == ["COUNT(*)", "MAX(DepId)"]
    assert len(rows(db, "SELECT * FROM Emp e FULL JOIN Dep d ON d.DepId = e.DepId")) == 2
    said(db, "SELECT Name FROM Emp JOIN Dep ON Emp.DepId = Dep.DepId", "Binding Error", True)
    said(db, "SELECT Emp.Name FROM Emp JOIN Dep ON Emp.Nope = Dep.DepId", "Binding Error", True)
    said(db, "SELECT Nope FROM Emp", "Invalid column name: Nope", True)
    said(db, "SELECT SUM(Name) FROM Emp", "numeric", True)
    said(
        db,
        "SELECT Name FROM Emp WHERE EXISTS (SELECT DepId FROM Dep WHERE Dep.DepId = Emp.DepId)",
        "Correlated subqueries are not supported yet",
        True,
    )
    said(db, "SELECT Name FROM Emp WHERE EmpId IN (SELECT DepId, Name FROM Dep)", "exactly one column", True)
    said(db, "SELECT Name FROM Emp WHERE EmpId = (SELECT EmpId FROM Emp)", "more than one row", True)
    said(db, "SELECT RANK() FROM Emp", "Function 'RANK' is not supported yet", True)
    said(db, "SELECT RANK() FROM Emp", "Parser Error", True)
    said(db, "SELECT EmpId FROM Emp UNION SELECT Name FROM Emp", "incompatible types", True)
    said(db, "SELECT EmpId FROM Emp UNION SELECT EmpId, Name FROM Emp", "same number of columns", True)
    said(db, "(SELECT EmpId FROM Emp)", "Parenthesized SELECT or compound queries are not supported yet", True)
    said(db, "SELECT EmpId FROM Emp UNION (SELECT EmpId FROM Emp)", "Parenthesized UNION branches are not supported yet", True)
    said(db, "SELECT EmpId, RANK() OVER (PARTITION BY Name) FROM Emp", "ORDER BY", True)
    said(db, "SELECT RANK() OVER (ORDER BY EmpId ROWS) FROM Emp", "Unsupported window specification syntax", True)
    said(db, "SELECT * FROM Nope", "does not exist", True)
    r = db.execute("SELECT *\nFROM Emp WHERE ^")[0]
    assert r.is_error and (r.line, r.column) == (2, 16)
    out = db.execute("SELECT Nope FROM Emp; SELECT EmpId FROM Emp /* two */ -- done")
    assert [x.is_error for x in out] == [True, False]
    assert rows(db, "SELECT Name + '-' + EmpId AS t, EmpId-1 AS m FROM Emp WHERE EmpId > 1") == [("Bob-2", 1)]
    with pytest.raises(SqlError):
        db.sql("SELECT Nope FROM Emp")


def test_definitions(db):
    said(db, "CREATE DATABASE IF NOT EXISTS d", "already exists. Skipping creation", False)
    said(db, "DROP TABLE IF EXISTS nope", "does not exist. Skipping drop", False)
    said(db, "CREATE TABLE u (Id INT PRIMARY KEY, Name VARCHAR(50))", "successfully created", False)
    ok(db, "INSERT INTO u VALUES (1, '12'), (2, 'abc'); ALTER TABLE u ADD Age INT DEFAULT 3; ALTER TABLE u ADD COLUMN Z VARCHAR")
    assert rows(db, "SELECT * FROM u ORDER BY Id") == [(1, "12", 3, None), (2, "abc", 3, None)]
    said(db, "ALTER TABLE u ADD K INT UNIQUE", "currently supports only nullable/default columns", True)
    said(db, "ALTER TABLE u DROP COLUMN Id", "PRIMARY KEY", True)
    said(db, "ALTER TABLE u MODIFY Name INT", "cannot convert existing value", True)
    ok(db, "ALTER TABLE u MODIFY COLUMN Name VARCHAR(2)")
    assert rows(db, "SELECT Name FROM u WHERE Id = 2") == [("ab",)]
    ok(db, "ALTER TABLE u DROP COLUMN Name")
    said(db, "SELECT Name FROM u", "Invalid column name: Name", True)
    ok(db, "CREATE TABLE one (A INT)")
    said(db, "ALTER TABLE one DROP A", "last remaining column", True)
    said(db, "VACUUM one", "0 rows compacted", False)
    ok(db, "CREATE INDEX ix ON u(Age)")
    said(db, "ALTER TABLE u DROP Age", "index", True)
    ok(db, "DROP INDEX ix ON u; VACUUM u")
    assert ok(db, "DESCRIBE u").fields == ["Id", "Age", "Z"] and len(rows(db, "SELECT * FROM u")) == 2
    assert [r["TableName"] for r in ok(db, "SHOW TABLES").rows] == ["u", "one"] and ok(db, "SHOW DATABASES").rows == [{"DatabaseName": "d"}]
    ok(db, "DROP TABLE one GO DROP DATABASE d")
    said(db, "SELECT * FROM u", "does not exist", True)


def test_transactions(db):
    ok(db, "CREATE TABLE t (Id INT PRIMARY KEY, N VARCHAR(50)); INSERT INTO t VALUES (1, 'a')")
    said(db, "COMMIT", "No active transaction", True)
    ok(db, "BEGIN TRANSACTION; INSERT INTO t VALUES (2, 'b'); UPDATE t SET N = 'z' WHERE Id = 1")
    said(db, "BEGIN", "already active", True)
    other = Session(db.spark, catalog=db.catalog)
    other.execute("USE d")
    assert rows(other, "SELECT N FROM t") == [("a",)] and sorted(rows(db, "SELECT N FROM t")) == [("b",), ("z",)]
    ok(other, "INSERT INTO t VALUES (3, 'c')")
    said(db, "COMMIT", "Transaction committed.", False)
    assert sorted(rows(other, "SELECT * FROM t")) == [(1, "z"), (2, "b"), (3, "c")]
    ok(db, "BEGIN; DELETE FROM t")
    said(db, "ROLLBACK", "Transaction rolled back.", False)
    assert len(rows(db, "SELECT * FROM t")) == 3


def test_reopen(spark, tmp_path):
    root = str(tmp_path)
    s = Session(spark, root)
    ok(s, "CREATE DATABASE d; USE d; CREATE TABLE t (Id INT PRIMARY KEY, D DATE DEFAULT '2020-01-02'); INSERT INTO t (Id) VALUES (1)")
    ok(s, "INSERT INTO t (Id) VALUES " + ", ".join(f"({i})" for i in range(2, 1300)))
    (tmp_path / "_manifest" / "9999999999.json").write_text("{ torn")
    again = Session(spark, root)
    again.execute("USE d")
    assert rows(again, "SELECT COUNT(*) AS n, MIN(D) AS d FROM t") == [(1299, datetime.date(2020, 1, 2))]
    said(again, "INSERT INTO t (Id) VALUES (77)", "Primary key violation", False)


def test_threads(spark):
    s = Session(spark)
    ok(s, "CREATE DATABASE d; USE d; CREATE TABLE t (Id INT PRIMARY KEY)")

    def one(i):
        own = Session(spark, catalog=s.catalog)
        own.execute("USE d")
        ok(own, f"INSERT INTO t VALUES ({i})")

    threads = [threading.Thread(target=one, args=(i,)) for i in range(24)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows(s, "SELECT COUNT(*) AS n FROM t") == [(24,)]


def test_dbapi(spark):
    with connect(spark) as c:
        cur = c.cursor()
        cur.execute("CREATE TABLE t (Id INT PRIMARY KEY, N VARCHAR)")
        assert cur.execute("INSERT INTO t VALUES (?, ?), (?, ?)", [1, "it's", 2, None]).rowcount == 2
        assert cur.execute("SELECT * FROM t WHERE Id = @id", {"id": 1, "id2": 2}).fetchall() == [(1, "it's")]
        cur.execute("SELECT Id FROM t ORDER BY Id; SELECT N FROM t WHERE Id = 2")
        assert [d[0] for d in cur.description] == ["Id"] and cur.fetchone() == (1,) and cur.fetchmany(5) == [(2,)]
        assert cur.nextset() and cur.fetchone() == (None,) and not cur.nextset()
        with pytest.raises(KeyError):
            cur.execute("SELECT Id FROM t").fetchdict()["Nope"]
        c.begin()
        cur.execute("DELETE FROM t")
        c.rollback()
        assert cur.execute("SELECT COUNT(*) AS n FROM t").fetchone() == (2,)
        with pytest.raises(SqlError):
            cur.execute("SELECT Nope FROM t")


def test_pushdown(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = Q.session(spark, SF).sql(
        "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_shipdate >= '1998-01-01'",
    )._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49" in plan and "GreaterThanOrEqual(l_shipdate" in plan and "l_extendedprice" not in plan
