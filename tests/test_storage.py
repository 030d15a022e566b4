"""Files behind tables: what statements write, two drivers on one root, other stores, rows looked up by key."""

import datetime
import logging
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.dbapi import connect
from tessera.session import Session
from tessera.sources.catalog import Catalog
from tessera.sources.storage import FolderStorage, HadoopStorage


def ok(s, sql):
    out = s.execute(sql)
    assert not any(r.is_error for r in out), [r.messages for r in out]
    return out[-1]


def rows(s, sql):
    return [tuple(r) for r in s.sql(sql).collect()]


@pytest.fixture
def db(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    ok(s, "CREATE DATABASE d; USE d; CREATE TABLE t (Id INT PRIMARY KEY, N INT, D DATE)")
    s.load(
        "t",
        spark.range(4000).repartitionByRange(4, "id").select(
            F.col("id").cast("int").alias("Id"),
            (F.col("id") % 10).cast("int").alias("N"),
            F.lit(datetime.date(2024, 1, 2)).alias("D"),
        ),
    )
    return s


def files(path):
    return {f for _, _, names in os.walk(path / "d") for f in names if f.endswith(".parquet")}


def test_only_files_with_hits_are_written_again(db, tmp_path):
    before = files(tmp_path)
    assert len(before) == 4
    assert ok(db, "UPDATE t SET N = 99 WHERE Id = 5").messages == ["Rows affected: 1"]
    assert len([p for p, _ in db.catalog.databases["d"]["t"].parts if p.endswith(".parquet")]) == 3
    assert rows(db, "SELECT N FROM t WHERE Id = 5") == [(99,)] and rows(
        db,
        "SELECT COUNT(*) AS n, SUM(N) AS s FROM t",
    ) == [(4000, 18000 - 5 + 99)]
    held = files(tmp_path)
    assert ok(
        db,
        "UPDATE t SET N = 1 WHERE Id = -7",
    ).messages == ["Rows affected: 0"] and ok(db, "DELETE FROM t WHERE N = 1000").messages == ["Rows affected: 0"]
    assert files(tmp_path) == held
    ok(db, "INSERT INTO t VALUES (9000, 1, NULL)")
    assert ok(db, "DELETE FROM t WHERE Id < 2000").messages == ["Rows affected: 2000"]
    assert rows(db, "SELECT COUNT(*) AS n, MIN(Id) AS a FROM t") == [(2001, 2000)]
    assert ok(db, "DELETE FROM t WHERE Id = 9000 OR Id = 2000").messages == ["Rows affected: 2"]
    ok(db, "VACUUM t")
    assert len(db.catalog.databases["d"]["t"].parts) == 1 and rows(db, "SELECT COUNT(*) AS n FROM t") == [(1999,)]


def test_columns_come_and_go_without_rewriting(db, tmp_path):
    before = files(tmp_path)
    ok(
        db,
        "ALTER TABLE t ADD COLUMN E VARCHAR(5) DEFAULT 'x'; INSERT INTO t (Id, E) VALUES (5000, NULL), (5001, 'y'); ALTER TABLE t DROP COLUMN N; ALTER TABLE t ADD N VARCHAR",
    )
    assert files(tmp_path) == before
    assert rows(
        db,
        "SELECT Id, E, N FROM t WHERE Id = 7 OR Id >= 5000 ORDER BY Id",
    ) == [(7, "x", None), (5000, None, None), (5001, "y", None)]
    ok(db, "UPDATE t SET N = 'new' WHERE Id = 7; DELETE FROM t WHERE E = 'y'")
    again = Session(db.spark, str(tmp_path))
    again.execute("USE d")
    assert rows(again, "SELECT Id, E, N FROM t WHERE N = 'new' OR E IS NULL ORDER BY Id") == [(7, "x", "new"), (5000, None, None)]
    ok(again, "ALTER TABLE t MODIFY COLUMN E VARCHAR(1); VACUUM t")
    assert rows(again, "SELECT COUNT(*) AS n FROM t WHERE E = 'x'") == [(4000,)]


def test_keys_are_looked_up(db):
    db.execute("INSERT INTO t VALUES (10000, 1, NULL)")
    began = time.time()
    for i in range(20):
        assert ok(db, f"INSERT INTO t VALUES ({10_001 + i}, 1, NULL)").messages == ["Rows affected: 1"]
    assert (time.time() - began) / 20 < 0.2
    assert any("Primary key violation" in m for m in db.execute("INSERT INTO t VALUES (3999, 1, NULL)")[0].messages)
    state = db.catalog.databases["d"]["t"]
    few, many = {(1,), (-1,), (10_001,)}, {(i,) for i in range(3000, 5000)}
    assert db.catalog.look_up(state, ["Id"], few) == {(1,)} and len(db.catalog.look_up(state, ["Id"], many)) == 1000


def test_update_takes_what_insert_takes(db):
    for sql in ("UPDATE t SET N = 2.7", "UPDATE t SET N = '2.7'", "UPDATE t SET N = 'x' WHERE Id = 1", "UPDATE t SET D = 'never'"):
        assert any("doesn't match" in m for m in db.execute(sql)[0].messages), sql
    ok(db, "UPDATE t SET D = '02/04/2024', N = 2.0 WHERE Id = 3; UPDATE t SET N = '12' WHERE Id = 4")
    assert rows(
        db,
        "SELECT N, D FROM t WHERE Id = 3",
    ) == [(2, datetime.date(2024, 2, 4))] and rows(db, "SELECT N FROM t WHERE Id = 4") == [(12,)]


def test_given_up_work_leaves_no_files(db, tmp_path):
    before = files(tmp_path)
    ok(db, "BEGIN; UPDATE t SET N = 0 WHERE Id > 10; DELETE FROM t WHERE Id = 3")
    assert files(tmp_path) > before
    ok(db, "ROLLBACK")
    assert files(tmp_path) == before
    assert any("Constraint violation" in m for m in db.execute("UPDATE t SET Id = 1 WHERE Id < 3")[0].messages)
    assert files(tmp_path) == before
    ok(db, "DROP TABLE t")
    assert not files(tmp_path)


def test_failed_statement_of_a_transaction_leaves_nothing(db):
    ok(
        db,
        "CREATE TABLE c (Id INT PRIMARY KEY, T INT REFERENCES t(Id)); INSERT INTO c VALUES (1, 5); BEGIN; INSERT INTO t VALUES (-1, 0, NULL)",
    )
    assert any("Foreign key violation" in m for m in db.execute("DELETE FROM t WHERE Id < 10")[0].messages)
    ok(db, "COMMIT")
    assert rows(db, "SELECT COUNT(*) AS n FROM t") == [(4001,)]


def test_two_drivers_on_one_root(db, tmp_path):
    other = Session(db.spark, catalog=Catalog(db.spark, str(tmp_path)))
    other.execute("USE d")
    for i in range(5):
        ok(db, f"INSERT INTO t VALUES ({6000 + i}, 1, NULL)")
        ok(other, f"INSERT INTO t VALUES ({7000 + i}, 1, NULL)")
    ok(other, "BEGIN; DELETE FROM t WHERE Id = 7001")
    ok(db, "DELETE FROM t WHERE Id = 6001")
    ok(other, "COMMIT")
    assert rows(other, "SELECT COUNT(*) AS n FROM t WHERE Id >= 6000") == [(8,)]


def test_stores(spark, tmp_path):
    for store in (FolderStorage(str(tmp_path / "a")), HadoopStorage(spark, f"file://{tmp_path}/b")):
        assert store.names("x") == [] and store.create("x/1.json", "é") and not store.create("x/1.json", "other")
        assert store.read("x/1.json") == "é" and [n for n in store.names("x") if n.endswith(".json")] == ["1.json"]
        s = Session(spark, storage=store)
        ok(s, "CREATE DATABASE d; USE d; CREATE TABLE t (Id INT PRIMARY KEY)")
        ok(s, "INSERT INTO t VALUES " + ", ".join(f"({i})" for i in range(1500)))
        ok(s, "DELETE FROM t WHERE Id < 10")
        assert any("Primary key violation" in m for m in s.execute("INSERT INTO t VALUES (77)")[0].messages)
        again = Session(spark, storage=store)
        again.execute("USE d")
        assert rows(again, "SELECT COUNT(*) AS n FROM t") == [(1490,)]
        store.remove("d")
        assert store.names("d") == []


def test_dialect_edges(db, caplog):
    def said(sql, text):
        assert any(text in m for m in db.execute(sql)[0].messages), sql

    said("SELECT Id FROM t WHERE", "condition after WHERE")
    said("SELECT Id, N FROM t ORDER BY 2", "ORDER BY needs")
    assert rows(db, "SELECT N, COUNT(*) AS c FROM t GROUP BY N HAVING c IN (400) AND N LIKE '3'") == [(3, 400)]
    with caplog.at_level(logging.INFO, logger="tessera"):
        r = ok(db, "SELECT COUNT(*) AS n FROM t")
        db.execute("SELECT Nope FROM t")
    assert r.messages == ["Rows selected: 1"] and r.rows == [{"n": 4000}] and len(r.kept) == 1
    assert any(
        x.levelname == "WARNING" and "Nope" in x.getMessage()
        for x in caplog.records
    ) and any("select" in x.getMessage() for x in caplog.records)


def test_long_results_stay_lazy(db):
    db.load("t", db.spark.range(100_000, 107_000).selectExpr("cast(id as int) AS Id", "1 AS N", "date'2024-01-01' AS D"))
    r = ok(db, "SELECT Id FROM t")
    assert r.messages == ["Rows selected: 11000"] and r.kept is None and len(r.rows) == 11_000


def test_scalar(spark):
    with connect(spark) as c:
        cur = c.cursor()
        cur.execute("CREATE TABLE t (Id INT); INSERT INTO t VALUES (4), (5)")
        assert cur.execute("SELECT MAX(Id) AS m FROM t").scalar() == 5 and cur.execute("SELECT Id FROM t WHERE Id = 9").scalar() is None
