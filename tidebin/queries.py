"""The engine's queries over the test tables, and the same answers in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dialect import to_spark
from .operators.engine import Engine
from .operators.pyramid import compact
from .plans import buckets
from .plans.model import DAY, Refused, TimeRange, Unsupported
from .plans.rules import Limits
from .sources import files
from .sources.catalog import Catalog, Table
from .sources.store import Store, default_root

T0 = 1_704_067_200  # 2024-01-01
EV = "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type, value, props, user_id % 4 AS device, user_id % 3 AS region FROM events"
LI = "SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount FROM lineitem"
OD = "SELECT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, o_orderpriority, o_orderstatus, o_totalprice FROM orders"


SH = "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS a, user_id % 4 AS b, value AS v FROM events"


def _t(day: int, second: int = 0) -> int:
    return T0 + day * DAY + second


def _table(sf: str, name: str, file: str, time: str, columns: str) -> Table:
    cols = [("ts", f"unix_seconds(cast({time} as timestamp))"), *[(c.split(" as ")[-1], c.split(" as ")[0]) for c in columns.split(", ")]]
    return Table(name, f"{sf}/{file}.parquet", tuple(cols), "ts", time)


def events_catalog(sf: str) -> Catalog:
    return Catalog([
        _table(sf, "ev", "events", "ts", "user_id, event_type, value, props, user_id % 4 as device, user_id % 3 as region"),
        _table(sf, "li", "lineitem", "l_shipdate", "l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount"),
        Table("sh", f"{sf}/events.parquet", (("ts", "unix_seconds(cast(ts as timestamp))"), ("a", "event_type"), ("b", "user_id % 4"), ("v", "value")), "ts", "ts"),
        _table(sf, "od", "orders", "o_orderdate", "o_orderpriority, o_orderstatus, o_totalprice"),
    ])


W18 = f"ts >= {_t(3)} AND ts <= {_t(21) - 1}"  # 18 whole days
WEDGE = f"ts >= {_t(3, 5000)} AND ts <= {_t(21, 7777)}"  # a part of a day at either end
BY = "FROM ev WHERE {w} GROUP BY event_type"
TB = "CAST(FLOOR(ts / {n}) * {n} AS BIGINT)"


def _ts(n: int, aggs: str, dims: str = "event_type", w: str = f"ts >= {_t(5)} AND ts <= {_t(8, 40000)}") -> str:
    b = f"CAST(FLOOR(ts / {n}) * {n} AS BIGINT)"
    return f"SELECT {b} AS bucket, {dims}, {aggs} FROM ev WHERE {w} GROUP BY {b}, {dims}"


S, C = "ROUND(SUM(value), 4) AS total", "COUNT(*) AS n"
#: name -> (SQL, days whose buckets are stored first: None for all of the window's, or a list counted from the window's first day)
SQL: dict[str, tuple[str, list[int] | None]] = {
    "range_sum_full_days": (f"SELECT event_type, {S} {BY.format(w=W18)}", None),
    "range_sum_head_tail": (f"SELECT event_type, {S}, {C} {BY.format(w=WEDGE)}", [0, 1, 5, 9]),
    "range_strict_bounds": (f"SELECT event_type, {C} {BY.format(w=f'ts > {_t(3) - 1} AND ts < {_t(9)}')}", [1, 2]),
    "range_between": (f"SELECT event_type, {C} {BY.format(w=f'ts BETWEEN {_t(3)} AND {_t(9) - 1}')}", [0, 1]),
    "range_tightest_bound": (f"SELECT event_type, {C} {BY.format(w=f'ts >= {_t(1)} AND ts >= {_t(3)} AND {_t(9)} > ts AND ts < {_t(12)}')}", [0, 3]),
    "range_sub_bucket": (f"SELECT event_type, {C} {BY.format(w=f'ts >= {_t(3, 100)} AND ts <= {_t(3, 9000)}')}", []),
    "range_reversed_between": (f"SELECT event_type, {C} {BY.format(w=f'{_t(12)} BETWEEN ts AND {_t(25)} AND ts >= {_t(3)} AND ts < {_t(15)}')}", [0, 1]),
    "cache_cold": (f"SELECT event_type, {S}, {C} {BY.format(w=W18)}", []),
    "cache_partial": (f"SELECT event_type, {S}, {C} {BY.format(w=W18)}", list(range(10))),
    "cache_full": (f"SELECT event_type, {S}, {C} {BY.format(w=W18)}", None),
    "cache_scattered_gaps": (f"SELECT event_type, {S}, {C} {BY.format(w=W18)}", [0, 2, 3, 7, 11, 17]),
    "cache_vanished_bucket": (f"SELECT event_type, {S}, {C} {BY.format(w=W18)}", None),
    "cache_empty_bucket": (f"SELECT event_type, {S}, {C} {BY.format(w=f'ts >= {_t(27)} AND ts < {_t(36)}')}", None),
    "agg_sum": (f"SELECT device, {S} FROM ev WHERE {W18} GROUP BY device", [0, 1, 2]),
    "agg_count_star": (f"SELECT device, {C} FROM ev WHERE {W18} GROUP BY device", [4, 5]),
    "agg_count_col": (f"SELECT device, COUNT(value) AS n FROM ev WHERE {W18} GROUP BY device", [4, 5]),
    "agg_min_max_aliased": (f"SELECT event_type, MAX(value) AS peak, MIN(value) AS low {BY.format(w=W18)}", [0, 1, 2, 3]),
    "agg_min_max_text": (f"SELECT device, MIN(event_type) AS first_type, MAX(event_type) AS last_type FROM ev WHERE {W18} GROUP BY device", [3]),
    "agg_avg": (f"SELECT event_type, ROUND(AVG(value), 6) AS a {BY.format(w=W18)}", [0, 1, 2, 3]),
    "agg_avg_multi": (f"SELECT device, region, ROUND(AVG(value), 6) AS a, ROUND(AVG(user_id), 6) AS u FROM ev WHERE {W18} GROUP BY device, region", [6, 7]),
    "agg_composite_add": (f"SELECT event_type, ROUND(SUM(value) + SUM(user_id), 4) AS t {BY.format(w=W18)}", [0, 9]),
    "agg_composite_ratio": (f"SELECT event_type, ROUND(SUM(value) / COUNT(*), 6) AS r, ROUND(MAX(value) - MIN(value), 6) AS spread {BY.format(w=W18)}", [0, 9]),
    "agg_ungrouped": (f"SELECT {S}, {C}, ROUND(AVG(value), 6) AS a FROM ev WHERE {W18}", [0, 9]),
    "agg_stddev": (f"SELECT event_type, ROUND(STDDEV_SAMP(value), 5) AS sd, ROUND(VAR_POP(value), 4) AS v {BY.format(w=W18)}", [0, 9]),
    "agg_identical_days": (f"SELECT COUNT(*) AS n, CAST(SUM(1 + 0 * user_id) AS BIGINT) AS ones FROM ev WHERE {W18}", None),
    "ts_300": (_ts(300, f"{S}, {C}"), [0, 1]),
    "ts_600": (_ts(600, f"{S}, {C}"), [0, 1]),
    "ts_900": (_ts(900, f"{S}, {C}"), [2]),
    "ts_3600": (_ts(3600, f"{S}, {C}", "device"), [0, 1, 2]),
    "ts_2100": (_ts(2100, f"{S}, {C}"), [0, 2]),
    "ts_raw": (f"SELECT ts, event_type, {C} FROM ev WHERE ts >= {_t(5)} AND ts < {_t(8)} GROUP BY ts, event_type", [1]),
    "ts_avg_by_type": (_ts(600, "ROUND(AVG(value), 6) AS a"), [0]),
    "filter_eq": (f"SELECT device, {S} FROM ev WHERE {W18} AND event_type = 'click' GROUP BY device", [0, 1]),
    "filter_in": (f"SELECT device, {S} FROM ev WHERE {W18} AND event_type IN ('click', 'view') GROUP BY device", [0, 1]),
    "filter_ne": (f"SELECT device, {S} FROM ev WHERE {W18} AND event_type <> 'click' GROUP BY device", [0, 1]),
    "filter_or": (f"SELECT device, {S} FROM ev WHERE {W18} AND (event_type = 'click' OR value > 50) GROUP BY device", [0, 1]),
    "filter_time_modulo": (f"SELECT event_type, {C} {BY.format(w=W18 + ' AND ts % 7 = 3')}", [0, 1, 2]),
    "filter_time_or": (f"SELECT event_type, {C} {BY.format(w=W18 + f' AND (device = 1 OR ts > {_t(9)})')}", [0, 1, 2]),
    "filter_like": (f"SELECT event_type, {C} {BY.format(w=W18 + chr(32) + 'AND event_type LIKE ' + chr(39) + '%i%' + chr(39))}", [0, 1]),
    "post_order_limit": (f"SELECT user_id, COUNT(*) AS n FROM ev WHERE {W18} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10", [0, 1, 2]),
    "post_order_expr": (f"SELECT user_id, {S} FROM ev WHERE {W18} GROUP BY user_id ORDER BY SUM(value) - 2 * COUNT(*) DESC, user_id LIMIT 7", [0, 1, 2]),
    "post_order_ordinal": (f"SELECT user_id, COUNT(*) AS n FROM ev WHERE {W18} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", [0, 1]),
    "post_offset": (f"SELECT user_id, COUNT(*) AS n FROM ev WHERE {W18} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 6 OFFSET 4", [0, 1, 2]),
    "post_having": (f"SELECT user_id, COUNT(*) AS n FROM ev WHERE {W18} GROUP BY user_id HAVING COUNT(*) > 30", [0, 1, 2]),
    "bypass_distinct": (f"SELECT DISTINCT event_type, device FROM ev WHERE {W18}", []),
    "bypass_join": (f"SELECT a.event_type, COUNT(*) AS n FROM ev a JOIN (SELECT DISTINCT device FROM ev WHERE value > 10) b ON a.device = b.device WHERE a.ts >= {_t(3)} AND a.ts < {_t(9)} GROUP BY a.event_type", []),
    "bypass_cross_join": (f"SELECT COUNT(*) AS n FROM ev, (SELECT DISTINCT event_type AS e FROM ev) d WHERE ts >= {_t(3)} AND ts < {_t(9)}", []),
    "bypass_count_distinct": (f"SELECT event_type, COUNT(DISTINCT user_id) AS n {BY.format(w=W18)}", []),
    "bypass_median": (f"SELECT event_type, ROUND(MEDIAN(value), 6) AS m {BY.format(w=W18)}", []),
    "bypass_window": (f"SELECT event_id, n FROM (SELECT user_id AS event_id, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, user_id) AS r FROM ev WHERE {W18} GROUP BY user_id) x WHERE r <= 5", []),
    "bypass_rollup": (f"SELECT COALESCE(event_type, 'all') AS k, COALESCE(CAST(device AS VARCHAR(9)), 'all') AS d, {C} FROM ev WHERE {W18} GROUP BY ROLLUP (event_type, device)", []),
    "bypass_cte": (f"WITH x AS (SELECT event_type, value FROM ev WHERE {W18}) SELECT event_type, COUNT(*) AS n FROM x GROUP BY event_type", []),
    "bypass_union": (f"SELECT event_type AS k, {C} {BY.format(w=W18)} UNION ALL SELECT CAST(device AS VARCHAR(9)) AS k, {C} FROM ev WHERE {W18} GROUP BY device", []),
    "bypass_no_aggregate": (f"SELECT ts, user_id, value FROM ev WHERE ts >= {_t(3)} AND ts <= {_t(3, 20000)}", []),
    "bypass_scalar_subquery": (f"SELECT event_type, {C} {BY.format(w=W18 + ' AND value > (SELECT AVG(value) FROM ev)')}", []),
    "bypass_intersect": (f"SELECT event_type FROM ev WHERE {W18} INTERSECT SELECT event_type FROM ev WHERE device = 1", []),
    "bypass_except": (f"SELECT user_id FROM ev WHERE {W18} EXCEPT SELECT user_id FROM ev WHERE ts >= {_t(10)}", []),
    "bypass_semi_join": (f"SELECT event_type, {C} FROM ev WHERE {W18} AND EXISTS (SELECT 1 FROM ev b WHERE b.user_id = ev.user_id AND b.value > 99) GROUP BY event_type", []),
    "bypass_anti_join": (f"SELECT event_type, {C} FROM ev WHERE {W18} AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = ev.user_id AND b.value > 99) GROUP BY event_type", []),
    "gap_subquery": (f"SELECT x.event_type, {C} FROM (SELECT * FROM ev WHERE {W18}) x WHERE x.device < 3 GROUP BY x.event_type", [0, 1, 5]),
    "gap_subquery_columns": (f"SELECT device, ROUND(SUM(y.value), 4) AS total FROM (SELECT ts, device, value FROM ev e WHERE e.value > 10) y WHERE y.ts >= {_t(3)} AND y.ts < {_t(9, 500)} GROUP BY device", [2, 3]),
    "text_length_dimension": (f"SELECT LENGTH(props) AS len, {C} FROM ev WHERE {W18} GROUP BY LENGTH(props)", [0, 1, 2]),
    "group_a_b": (f"SELECT a, b, ROUND(SUM(v), 4) AS s, COUNT(*) AS n FROM sh WHERE {W18} GROUP BY a, b", [0, 1, 2]),
    "literal_like_dimension": (f"SELECT CASE WHEN event_type = 'view event_type' THEN 'event_types' ELSE 'other event_type' END AS k, COUNT(*) AS n FROM ev WHERE {W18} GROUP BY event_type HAVING MAX(event_type) <> 'MAX(event_type)'", [0, 1, 2]),
    "mixed_case": (f"SELECT Event_Type AS k, CAST(SUM(Device) AS BIGINT) AS d, CAST(sum(device) + COUNT(*) AS BIGINT) AS e FROM EV WHERE {W18} GROUP BY event_type HAVING sum(DEVICE) > 3", [0, 1, 2]),
    "post_nulls_first": (f"SELECT user_id, MAX(CASE WHEN value > 300 THEN value END) AS m FROM ev WHERE {W18} GROUP BY user_id ORDER BY m NULLS FIRST, user_id LIMIT 12", [0, 1, 2]),
    "post_nulls_last": (f"SELECT user_id, MAX(CASE WHEN value > 300 THEN value END) AS m FROM ev WHERE {W18} GROUP BY user_id ORDER BY m DESC NULLS LAST, user_id LIMIT 12", [0, 1, 2]),
}
UTC = "make_timestamp(CAST(ts AS BIGINT) * 1000000)"
#: name -> (text in MySQL's spelling, the same for the oracle)
MYSQL: dict[str, tuple[str, str]] = {
    "dialect_date": (
        f"SELECT DATE(FROM_UNIXTIME(ts)) AS d, ADDDATE(DATE(FROM_UNIXTIME(ts)), 1) AS e, SUBDATE(DATE(FROM_UNIXTIME(ts)), 2) AS f, {C} FROM ev WHERE {W18} GROUP BY DATE(FROM_UNIXTIME(ts))",
        f"SELECT CAST({UTC} AS DATE) AS d, CAST({UTC} AS DATE) + 1 AS e, CAST({UTC} AS DATE) - 2 AS f, {C} FROM ev WHERE {W18} GROUP BY CAST({UTC} AS DATE)",
    ),
    "dialect_null": (f"SELECT IFNULL(NULLIF(event_type, 'view'), 'IFNULL(x)') AS k, {C} FROM ev WHERE {W18} GROUP BY IFNULL(NULLIF(event_type, 'view'), 'IFNULL(x)')",) * 2,
    "dialect_math": (
        f"SELECT SIGN(value - 50) AS g, ROUND(SUM(POW(value, 2)), 2) AS p, ROUND(SUM(LOG(value + 1)), 4) AS l, ROUND(SUM(LOG(2, value + 1)), 4) AS m FROM ev WHERE {W18} GROUP BY SIGN(value - 50)",
        f"SELECT CAST(SIGN(value - 50) AS DOUBLE) AS g, ROUND(SUM(POW(value, 2)), 2) AS p, ROUND(SUM(LN(value + 1)), 4) AS l, ROUND(SUM(LOG(2, value + 1)), 4) AS m FROM ev WHERE {W18} GROUP BY SIGN(value - 50)",
    ),
    "dialect_string": (f"SELECT CONCAT(event_type, '-', LENGTH(event_type)) AS k, FORMAT(COUNT(*) * 1000, 2) AS f {BY.format(w=W18)}", f"SELECT CONCAT(event_type, '-', LENGTH(event_type)) AS k, format('{{:,.2f}}', COUNT(*) * 1000.0::DOUBLE) AS f {BY.format(w=W18)}"),
    "dialect_json": (
        f"SELECT JSON_EXTRACT(props, '$.k') AS j, {C} FROM ev WHERE {W18} GROUP BY JSON_EXTRACT(props, '$.k')",
        f"SELECT json_extract_string(props, '$.k') AS j, {C} FROM ev WHERE {W18} GROUP BY json_extract_string(props, '$.k')",
    ),
    "dialect_format": (
        f"SELECT DATE_FORMAT(FROM_UNIXTIME(ts), '%Y-%m-%d %H:%i %a %b') AS d, {C} FROM ev WHERE {W18} AND ts >= UNIX_TIMESTAMP(STR_TO_DATE('2024-01-05', '%Y-%m-%d')) GROUP BY DATE_FORMAT(FROM_UNIXTIME(ts), '%Y-%m-%d %H:%i %a %b')",
        f"SELECT strftime({UTC}, '%Y-%m-%d %H:%M %a %b') AS d, {C} FROM ev WHERE {W18} AND ts >= {_t(4)} GROUP BY strftime({UTC}, '%Y-%m-%d %H:%M %a %b')",
    ),
    "dialect_cast": (f"SELECT CAST(device AS CHAR) AS k, SUM(CAST(value AS SIGNED)) AS v, MAX(CAST(region AS UNSIGNED)) AS r FROM ev WHERE {W18} GROUP BY CAST(device AS CHAR)", f"SELECT CAST(device AS VARCHAR) AS k, CAST(SUM(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS v, MAX(CAST(region AS BIGINT)) AS r FROM ev WHERE {W18} GROUP BY device"),
}
UNION = " UNION ALL ".join(f"SELECT event_type AS k, {C} {BY.format(w=w)}" for w in (W18, WEDGE))
UNION_ONCE = f"SELECT event_type AS k {BY.format(w=W18)} HAVING COUNT(*) > 0 UNION SELECT MAX(event_type) AS k FROM ev WHERE {WEDGE} UNION SELECT 'none' AS k"
INJECTED = f"SELECT ts, event_type, {C} FROM ev WHERE ts >= {_t(5, 100)} AND ts < {_t(8)} GROUP BY ts, event_type"
COMMANDS = ("INSERT INTO ev SELECT * FROM ev", "DROP TABLE ev", "CREATE TABLE z AS SELECT 1 AS x", "DELETE FROM ev WHERE ts > 1", "UPDATE ev SET ts = 1", "TRUNCATE TABLE ev", "SET a.b=1", "CACHE TABLE ev", "ALTER TABLE ev RENAME TO ew")
COARSE = 365 * DAY
LI_SQL = "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 6) AS disc, COUNT(*) AS n FROM li WHERE ts >= 788918400 AND ts < 915148800 GROUP BY l_returnflag, l_linestatus"
OD_SQL = "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS price, MAX(o_orderstatus) AS st FROM od WHERE ts >= 788918400 AND ts < 915148800 GROUP BY o_orderpriority"
CUBES = {
    "cube_rollup": (f"SELECT event_type, device, {S}, {C} FROM ev WHERE {W18} GROUP BY event_type, device", f"SELECT device, {S}, {C} FROM ev WHERE {W18} GROUP BY device"),
    "cube_filter_down": (f"SELECT event_type, device, {S} FROM ev WHERE {W18} GROUP BY event_type, device", f"SELECT device, {S} FROM ev WHERE {W18} AND event_type IN ('click', 'view') GROUP BY device"),
    "cube_avg": (f"SELECT event_type, region, AVG(value) AS a FROM ev WHERE {W18} GROUP BY event_type, region", f"SELECT region, ROUND(AVG(value), 6) AS a FROM ev WHERE {W18} GROUP BY region"),
    "cube_max_aliased": (f"SELECT event_type, region, MAX(value) AS peak FROM ev WHERE {W18} GROUP BY event_type, region", f"SELECT region, MAX(value) AS top FROM ev WHERE {W18} GROUP BY region"),
    "cube_or_filter": (f"SELECT event_type, device, {C} FROM ev WHERE {W18} GROUP BY event_type, device", f"SELECT device, {C} FROM ev WHERE {W18} AND (event_type = 'click' OR device = 2) GROUP BY device"),
    "cube_sub_window": (f"SELECT event_type, device, {C} FROM ev WHERE {W18} GROUP BY event_type, device", f"SELECT device, {C} FROM ev WHERE ts >= {_t(5, 77)} AND ts < {_t(9)} GROUP BY device"),
    "cube_time_series": (_ts(300, C, "event_type, device"), _ts(3600, C, "device")),
}


def engine(spark: SparkSession, sf: str, **limits) -> Engine:
    return Engine(spark, events_catalog(sf), limits=Limits(**limits))


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, days = SQL[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark, sf)
        if days is None or days:
            q, _, family = e.read(sql)
            body = buckets.split(q.span)[1]
            e.warm(sql, None if days is None else [body[d] for d in days if d < len(body)])
            if name == "cache_vanished_bucket":  # files go, their markers stay; what was stored in another write is still used
                lost = e.store.markers(family)[0].attempt
                e.warm(sql, body[4:9], force=True)
                p, fs = files.at(spark, e.store.path(e.store.tenant, family, lost))
                fs.delete(p, True)
                assert len(e.answer(sql).stored) == 5
        return e.answer(sql).frame

    return run


def _cube(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark, sf)
        e.warm(CUBES[name][0])
        return e.answer(CUBES[name][1]).frame

    return run


def _coarse(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark, sf, bucket=COARSE)
        e.warm(sql)
        return e.answer(sql).frame

    return run


def gap_union_all(spark: SparkSession, sf: str) -> DataFrame:
    """One text: each branch takes its stored buckets and computes its own gaps."""
    e = engine(spark, sf)
    e.warm(UNION.split(" UNION ALL ")[0], [_t(4), _t(5)])
    return e.answer(UNION).frame


def gap_union(spark: SparkSession, sf: str) -> DataFrame:
    """Equal rows count once; the last branch has no table and runs on Spark."""
    e = engine(spark, sf)
    e.warm(UNION_ONCE.split(" UNION ")[0], [_t(4), _t(5)])
    return e.answer(UNION_ONCE).frame


def time_injection(spark: SparkSession, sf: str) -> DataFrame:
    """A bare time column among the groups stands for its 300-second bucket; WHERE keeps the seconds."""
    e = engine(spark, sf, time_step=300)
    e.warm(INJECTED, [_t(6)])
    return e.answer(INJECTED).frame


def _mysql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark, sf)
        e.warm(to_spark(MYSQL[name][0]), [_t(4), _t(5), _t(9)])
        return e.answer(MYSQL[name][0], "mysql").frame

    return run


def commands_refused(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    out = []
    for sql in COMMANDS:
        try:
            e.answer(sql)
            out.append((sql, False))
        except Refused:
            out.append((sql, True))
    return spark.createDataFrame(out, "command string, refused boolean")


def rules_fire(spark: SparkSession, sf: str) -> DataFrame:
    """Which rule, if any, sends a query to Spark, under limits that ask for it."""
    sql = f"SELECT user_id, {C} FROM ev WHERE {W18} AND device = 1 GROUP BY user_id"
    odd = f"SELECT {TB.format(n=7)} AS t, {C} FROM ev WHERE {W18} GROUP BY {TB.format(n=7)}"
    cases = [
        ("none", sql, {}), ("high_cardinality", sql, {"high_cardinality": frozenset({"user_id"})}), ("clustered_filter", sql, {"clustered": frozenset({"device"})}), ("odd_step", odd, {}),
        ("short_range", sql, {"least_seconds": 30 * DAY}), ("part_of_bucket", f"SELECT {C} FROM ev WHERE ts >= {_t(3)} AND ts < {_t(3, 900)}", {}),
    ]
    out = []
    for name, text, limits in cases:
        try:
            engine(spark, sf, **limits).read(text)
            out.append((name, "none"))
        except Unsupported as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "expected string, fired string")


def cache_after_append(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of later days arrive after ten days were stored: their buckets stay, and are used."""
    root = f"{default_root(spark)}/grown"
    src = spark.read.parquet(f"{sf}/events.parquet")
    early = F.unix_seconds(F.col("ts").cast("timestamp")) < _t(20)
    src.where(early).write.parquet(f"{root}/day=early")
    table = next(t for t in (events_catalog(sf).find("ev"),))
    e = Engine(spark, Catalog([replace(table, path=root, _schema=[])]))
    sql = f"SELECT event_type, {C} {BY.format(w=f'ts >= {_t(3)} AND ts < {_t(25)}')}"
    e.warm(sql, [_t(d) for d in range(3, 13)])
    src.where(~early).write.parquet(f"{root}/day=late")
    spark.catalog.refreshByPath(root)
    a = e.answer(sql)
    return a.frame.withColumn("kept", F.lit(len(a.stored)).cast("long"))


def cache_after_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A late file with rows of two stored days: these are computed again, the others stay."""
    root = f"{default_root(spark)}/late"
    src = spark.read.parquet(f"{sf}/events.parquet")
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    late = (t >= _t(5)) & (t < _t(7)) & (F.col("user_id") % 2 == 0)
    src.where(~late).write.parquet(f"{root}/part=1")
    e = Engine(spark, Catalog([replace(events_catalog(sf).find("ev"), path=root, _schema=[])]))
    sql = f"SELECT event_type, {C} {BY.format(w=W18)}"
    e.warm(sql)
    src.where(late).write.parquet(f"{root}/part=2")
    spark.catalog.refreshByPath(root)
    a = e.answer(sql)
    return a.frame.withColumn("kept", F.lit(len(a.stored)).cast("long"))


def cache_corrupt_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """A stored file was cut short: its bucket counts as missing and is computed again."""
    e = engine(spark, sf)
    sql = SQL["cache_full"][0]
    e.warm(sql)
    family = e.read(sql)[2]
    file = files.matching(spark, e.store.path(e.store.tenant, family, "*", "*.parquet"))[0]
    files.write_text(spark, file.path, "PAR1")
    return e.answer(sql).frame


def cache_two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Two sessions store the same buckets: the sums do not double."""
    e = engine(spark, sf)
    other = Engine(spark, events_catalog(sf), Store(spark, e.store.root))
    sql = SQL["agg_sum"][0]
    e.warm(sql)
    other.warm(sql, force=True)
    return e.answer(sql).frame


def join_after_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension joins the merged measures, so that it never enters the store."""
    e = engine(spark, sf)
    sql = SQL["agg_sum"][0]
    e.warm(sql, [_t(4), _t(5)])
    names = spark.createDataFrame([(0, "north"), (1, "east"), (2, "south"), (3, "west")], "device long, name string")
    return e.answer(sql).frame.join(names, "device").select("name", "total")


def cube_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Each roll-up compared with its direct answer by joins of all rows."""
    out = []
    for name, (finer, coarse) in CUBES.items():
        e = engine(spark, sf)
        e.warm(finer)
        out.append((name, bool(e.answer(coarse).stored), e.verify(coarse)))
    return spark.createDataFrame(out, "cube string, used boolean, same boolean")


def bounded_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """All rows for a client, and an error where there are more than it takes."""
    e = engine(spark, sf)
    sql = SQL["agg_avg"][0]
    n = len(e.fetch(sql))
    try:
        e.fetch(sql, n - 1)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(n, refused)], "n long, refused boolean")


def votes_last(spark: SparkSession, sf: str) -> DataFrame:
    """A vote and what was asked outlast their session: the next one warms by them."""
    first = Engine(spark, events_catalog(sf), remember=True)
    first.vote(SQL["agg_sum"][0])
    first.answer(SQL["agg_avg"][0])
    other = Engine(spark, events_catalog(sf), Store(spark, first.store.root), remember=True)
    done = other.warm_cycle(TimeRange(_t(3), _t(9) - 1))
    return spark.createDataFrame([(len(done), sum(map(len, done.values())))], "families long, buckets long")


def popular_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The most asked families first."""
    e = engine(spark, sf)
    names = {e.read(SQL[n][0])[2]: n for n in ("agg_sum", "agg_avg", "agg_count_star")}
    for n, times in (("agg_sum", 1), ("agg_avg", 3), ("agg_count_star", 2)):
        for _ in range(times):
            e.answer(SQL[n][0])
    return spark.createDataFrame([(i + 1, names[f], n) for i, (f, n) in enumerate(e.popular.most_common(2))], "place long, query string, asked long")


def _hours(spark: SparkSession, sf: str, level: int) -> DataFrame:
    e = engine(spark, sf)
    sql = _ts(300, f"SUM(value) AS total, {C}", w=f"ts >= {_t(5)} AND ts < {_t(8)}")
    q = e.read(sql)[0]
    parts = compact(compact(e.compute(q, [q.span]), q, 3600), q, level)
    sums = [c for c in q.parts() if c.startswith("s_")]
    counts = [c for c in q.parts() if c.startswith("c_")]
    return parts.select(F.col("__t").alias("bucket"), F.col([c for c in parts.columns if c.startswith("d_")][0]).alias("event_type"), F.round(sums[0], 4).alias("total"), F.col(counts[0]).alias("n"))


def pyramid_hour_to_day(spark: SparkSession, sf: str) -> DataFrame:
    return _hours(spark, sf, DAY)


def pyramid_live_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Leading part, days, hours of the last day and the live rest of [start, now) side by side."""
    e = engine(spark, sf)
    start, now = _t(3, 5000), _t(9, 30_000)
    head, days, hours, live = buckets.assemble(start, now)
    sql = f"SELECT event_type, {C} {BY.format(w=f'ts >= {start} AND ts < {now}')}"
    q = e.read(sql)[0]
    ranges = [*([head] if head else []), *[TimeRange(d, d + DAY - 1) for d in days], *[TimeRange(h, h + 3599) for h in hours], *([live] if live else [])]
    return e.finish(q, e.compute(q, ranges))


def _sketches(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    e = engine(spark, sf, sketches=True)
    e.warm(sql, [_t(d) for d in range(3, 12)])
    a = e.answer(sql)
    assert a.stored and a.computed
    return a.frame


def sketch_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """HLL sketches, stored by day and merged with those of the gaps: within 2 % of the exact count (or one), which is five standard errors at any size."""
    got = _sketches(spark, sf, f"SELECT event_type, approx_count_distinct(user_id) AS users {BY.format(w=W18)}")
    exact = spark.sql(f"SELECT event_type, COUNT(DISTINCT user_id) AS n {BY.format(w=W18)}")
    return got.join(exact, "event_type").select("event_type", (F.abs(F.col("users") - F.col("n")) <= F.greatest(F.lit(1), F.col("n") * 0.02)).alias("within"))


def sketch_median(spark: SparkSession, sf: str) -> DataFrame:
    """KLL sketches, stored by day and merged with those of the gaps: the median within 3 % of rank."""
    got = _sketches(spark, sf, f"SELECT event_type, percentile_approx(value, 0.5) AS median {BY.format(w=W18)}")
    rows = spark.sql(f"SELECT event_type, value FROM ev WHERE {W18}").join(got, "event_type")
    share = F.avg((F.col("value") <= F.col("median")).cast("double"))
    return rows.groupBy("event_type").agg(share.alias("r"), F.count("*").alias("n")).select("event_type", (F.abs(F.col("r") - 0.5) <= 0.03 + 1 / F.col("n")).alias("within"))


def admin_size(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.warm(SQL["agg_sum"][0])
    return spark.createDataFrame([(t, s.buckets, 0 < s.bytes < 1_000_000) for t, s in e.store.size().items()], "tenant string, buckets long, bytes_in_bounds boolean")


def admin_flush(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.warm(SQL["agg_sum"][0])
    gone = e.store.flush(e.store.tenant)
    return spark.createDataFrame([(gone, sum(s.buckets for s in e.store.size().values()))], "flushed long, remaining long")


def warm_report(spark: SparkSession, sf: str) -> DataFrame:
    """Two cycles over one vote: the second finds all buckets stored."""
    e = engine(spark, sf)
    sql = SQL["cache_full"][0]
    window = TimeRange(_t(3), _t(9, 100))
    rows = []
    for cycle in (1, 2):
        e.vote(sql)
        rows.append((cycle, sum(len(x) for x in e.warm_cycle(window, now=_t(9, 100)).values())))
    return spark.createDataFrame(rows, "cycle long, stored long")


def canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Families of a query and of the same one with clauses, aliases and the window changed."""
    e = engine(spark, sf)
    a = f"SELECT event_type, {S}, {C} FROM ev WHERE {W18} AND device = 1 AND value > 2 GROUP BY event_type"
    b = f"SELECT COUNT(*) AS k, event_type, ROUND(SUM(value), 4) AS s FROM ev WHERE value > 2 AND device = 1 AND {WEDGE} GROUP BY event_type"
    return spark.createDataFrame([(e.read(a)[2] == e.read(b)[2],)], "same boolean")


OTHERS = {f.__name__: f for f in (gap_union_all, gap_union, time_injection, commands_refused, rules_fire, cache_after_append, cache_after_late_rows, cache_corrupt_bucket, cache_two_writers, join_after_merge, cube_verified, bounded_fetch, votes_last, popular_queries, pyramid_hour_to_day, pyramid_live_tail, sketch_distinct, sketch_median, admin_size, admin_flush, warm_report, canonical_hash)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _run(n) for n in SQL} | {n: _cube(n) for n in CUBES} | {n: _mysql(n) for n in MYSQL} | {"lineitem_yearly_sum": _coarse(LI_SQL), "orders_by_priority_avg": _coarse(OD_SQL)} | OTHERS


def _with(sql: str) -> str:
    views = f"ev AS ({EV}), li AS ({LI}), od AS ({OD}), sh AS ({SH})"
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"


def oracle_sql() -> dict[str, str]:
    out = {n: s for n, (s, _) in SQL.items()} | {n: s for n, (_, s) in CUBES.items()} | {"lineitem_yearly_sum": LI_SQL, "orders_by_priority_avg": OD_SQL}
    out |= {n: s for n, (_, s) in MYSQL.items()}
    same_types = "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)"
    yes = lambda rows: ", ".join(f"('{r}', true)" for r in rows)
    day = f"CAST(FLOOR(ts / {DAY}) * {DAY} AS BIGINT)"
    out |= {
        "gap_union_all": UNION,
        "gap_union": UNION_ONCE,
        "time_injection": INJECTED.replace("SELECT ts,", f"SELECT {TB.format(n=300)} AS ts,").replace("GROUP BY ts,", f"GROUP BY {TB.format(n=300)},"),
        "commands_refused": f"SELECT * FROM (VALUES {yes(COMMANDS)}) t(command, refused)",
        "rules_fire": "SELECT x AS expected, x AS fired FROM (VALUES ('none'), ('high_cardinality'), ('clustered_filter'), ('odd_step'), ('short_range'), ('part_of_bucket')) t(x)",
        "cache_after_append": f"SELECT event_type, {C}, CAST(10 AS BIGINT) AS kept {BY.format(w=f'ts >= {_t(3)} AND ts < {_t(25)}')}",
        "cache_after_late_rows": f"SELECT event_type, {C}, CAST(16 AS BIGINT) AS kept {BY.format(w=W18)}",
        "cache_corrupt_bucket": SQL["cache_full"][0],
        "cache_two_writers": SQL["agg_sum"][0],
        "join_after_merge": f"SELECT CASE device WHEN 0 THEN 'north' WHEN 1 THEN 'east' WHEN 2 THEN 'south' ELSE 'west' END AS name, {S} FROM ev WHERE {W18} GROUP BY device",
        "cube_verified": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true, true)" for n in CUBES) + ") t(cube, used, same)",
        "bounded_fetch": f"SELECT COUNT(*) AS n, true AS refused FROM ({SQL['agg_avg'][0]})",
        "votes_last": "SELECT CAST(2 AS BIGINT) AS families, CAST(12 AS BIGINT) AS buckets",
        "popular_queries": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'agg_avg', CAST(3 AS BIGINT)), (CAST(2 AS BIGINT), 'agg_count_star', CAST(2 AS BIGINT))) t(place, query, asked)",
        "sketch_distinct": f"SELECT event_type, true AS within FROM {same_types}",
        "sketch_median": f"SELECT event_type, true AS within FROM {same_types}",
        "admin_size": "SELECT 'default' AS tenant, CAST(18 AS BIGINT) AS buckets, true AS bytes_in_bounds",
        "pyramid_hour_to_day": f"SELECT {day} AS bucket, event_type, {S}, {C} FROM ev WHERE ts >= {_t(5)} AND ts < {_t(8)} GROUP BY {day}, event_type",
        "pyramid_live_tail": f"SELECT event_type, {C} {BY.format(w=f'ts >= {_t(3, 5000)} AND ts < {_t(9, 30_000)}')}",
        "admin_flush": "SELECT CAST(18 AS BIGINT) AS flushed, CAST(0 AS BIGINT) AS remaining",
        "warm_report": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(6 AS BIGINT)), (CAST(2 AS BIGINT), CAST(0 AS BIGINT))) t(cycle, stored)",
        "canonical_hash": "SELECT true AS same",
    }
    return {n: _with(s) for n, s in out.items()}
