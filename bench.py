"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line. Best of two runs after a warm-up run."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from tidebin import queries as Q  # noqa: E402

DIRECT = {
    "events_by_type_30_days": "SELECT event_type, SUM(value) AS s, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM ev WHERE ts >= {a} AND ts < {b} GROUP BY event_type",
    "events_300s_series": "SELECT CAST(FLOOR(ts / 300) * 300 AS BIGINT) AS t, event_type, SUM(value) AS s, COUNT(*) AS n FROM ev WHERE ts >= {a} AND ts < {b} GROUP BY CAST(FLOOR(ts / 300) * 300 AS BIGINT), event_type",
    "lineitem_by_flags": "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, SUM(l_extendedprice) AS p, AVG(l_discount) AS d, COUNT(*) AS n FROM li WHERE ts >= 788918400 AND ts < 1009843200 GROUP BY l_returnflag, l_linestatus",
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def timed(name, run, again=2):
        best = []
        for _ in range(again + 1):
            t = time.time()
            run()
            best.append(time.time() - t)
        took[name] = round(min(best[1:]) if again else best[0], 3)

    for name, sql in DIRECT.items():
        sql = sql.format(a=Q._t(0), b=Q._t(30))
        e = Q.engine(spark, sf, **({"bucket": Q.COARSE} if name.startswith("line") else {}))
        timed(f"{name}_direct", lambda: spark.sql(sql).collect())
        e.warm(sql)
        q, source, family = e.read(sql)
        timed(f"{name}_cached", lambda: e.answer(sql).frame.collect())
    timed("events_daily_sketches", lambda: spark.sql("SELECT event_type, FLOOR(ts / 86400) AS d, hll_sketch_agg(user_id, 12) AS h, kll_sketch_agg_double(value) AS k FROM ev GROUP BY event_type, FLOOR(ts / 86400)").collect())
    try:
        from tidebin.llm import queries as L
    except ImportError:
        L = None
    for name, f in (L.queries() if L else {}).items():
        timed(name, lambda: f(spark, sf).write.format("noop").mode("overwrite").save(), 0)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
