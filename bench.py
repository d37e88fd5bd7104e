"""Benchmark the headline queries.

Runs every query registered with ``headline=True`` on ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE
JSON line: total seconds, seconds per query, exchanges per plan, and the
same oracle SQL timed in DuckDB on the same files for reference.

Each query is fully materialised with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from tessera.catalog.registry import HEADLINE, QUERIES, SQL, load_all
    from tessera.session import get_spark

    load_all()
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": "16g"})
    names = only or list(HEADLINE)

    # warm-up: JVM, parquet footers, code generation
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times, exchanges = {}, {}
    for name in names:
        # timed from building the query: fitted statistics and checkpoints
        # some builders run eagerly count too
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                                         plan))

    duck = {}
    try:
        import duckdb
        con = duckdb.connect()
        con.execute(f"SET threads = {cpus}")
        for t in ("events customer orders lineitem part supplier nation region documents "
                  "embeddings pages benchmark labels conversations").split():
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        for i, name in enumerate(names):
            if name in SQL:
                t0 = time.perf_counter()
                con.execute(f"CREATE TEMP TABLE _bench_{i} AS {SQL[name]}")
                duck[name] = round(time.perf_counter() - t0, 3)
    except Exception as e:  # noqa: BLE001 - the reference timing is optional
        duck["error"] = str(e)[:200]

    total = round(sum(times.values()), 3)
    sf = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "cpus": cpus, "exchanges": exchanges, "duckdb_sec": duck}))
    spark.stop()


if __name__ == "__main__":
    main()
