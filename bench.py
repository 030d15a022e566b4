"""Times the headline queries (median of three runs) and small stored-table workloads; prints one JSON line."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tessera import queries as Q
from tessera.session import Session

HEADLINES = (
    "pricing",
    "filter_in_between",
    "arith_projection",
    "join_multi",
    "join_left",
    "group_agg",
    "count_distinct",
    "having_alias_order",
    "topk",
    "union_distinct",
    "in_subquery",
    "scalar_subquery",
    "rank_window",
    "cte_rank_top1",
    "dml_update",
)


def workloads(spark: SparkSession) -> dict[str, float]:
    """Single-row INSERTs, whole and filtered SELECTs and an UPDATE of all rows, on small stored tables; seconds of one run each."""
    s, took = Session(spark), {}

    def timed(name: str, *statements: str) -> None:
        began = time.perf_counter()
        for sql in statements:
            for r in s.execute(sql):
                if r.is_error:
                    raise RuntimeError(str(r.messages))
                _ = r.rows
        took[name] = round(time.perf_counter() - began, 4)

    s.execute(
        "CREATE DATABASE d; USE d; CREATE TABLE p (Id INT PRIMARY KEY, A VARCHAR, B VARCHAR); CREATE TABLE e (Id INT, N VARCHAR, D INT, S FLOAT); CREATE TABLE u (Id INT PRIMARY KEY, Val INT, Str VARCHAR)",
    )
    timed("insert_2000_single_rows", *[f"INSERT INTO p VALUES ({i}, 'a{i}', 'b{i}')" for i in range(2000)])
    timed("insert_8000_rows", "INSERT INTO p VALUES " + ", ".join(f"({i}, 'a{i}', 'b{i}')" for i in range(2000, 10_000)))
    timed("select_all_10000", "SELECT * FROM p")
    s.execute("INSERT INTO e VALUES " + ", ".join(f"({i}, 'n{i}', {i % 10}, {100_000 + i % 1000})" for i in range(5000)))
    timed("select_filter_5000", "SELECT * FROM e WHERE e.S > 100500")
    s.execute("INSERT INTO u VALUES " + ", ".join(f"({i}, {i}, 's{i}')" for i in range(1000)))
    timed("update_1000", "UPDATE u SET Val = 9999")
    s.close()
    return took


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config(
        "spark.sql.warehouse.dir",
        tempfile.mkdtemp(prefix="bench-"),
    ).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            Q.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    took |= workloads(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the headline queries' median seconds",
                "value": round(sum(took[k] for k in HEADLINES), 4),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")),
            },
        ),
    )


if __name__ == "__main__":
    main()
