"""python -m tidebin.cli --events DIR [--root DIR] [--dialect mysql] query SQL | warm SQL | vote SQL | warm-cycle [DAYS] | cache-size | flush [PREFIX]"""

from __future__ import annotations

import argparse
import time

from .operators.engine import Engine
from .plans.model import DAY, TimeRange
from .queries import events_catalog
from .sources.store import Store
from .sparkconf import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidebin")
    p.add_argument("--events", required=True, help="folder of events.parquet")
    p.add_argument("--root", help="folder of the store; without it, one in the session's warehouse, so that calls share it")
    p.add_argument("--dialect", choices=["mysql"], help="spelling of functions and casts")
    do = p.add_subparsers(dest="do", required=True)
    for name in ("query", "warm", "vote"):
        do.add_parser(name).add_argument("sql")
    cycle = do.add_parser("warm-cycle", help="stores what was voted for, then what is asked most")
    cycle.add_argument("days", nargs="?", type=int, default=7)
    cycle.add_argument("--now", type=int, default=None, help="epoch second that counts as now")
    do.add_parser("cache-size")
    do.add_parser("flush").add_argument("prefix", nargs="?", default="")
    a = p.parse_args(args)
    spark = session()
    root = a.root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidebin-store"
    engine = Engine(spark, events_catalog(a.events), Store(spark, root), remember=True)
    if a.do == "query":
        engine.answer(a.sql, a.dialect).frame.show(1000, False)
    elif a.do == "warm":
        print(engine.warm(a.sql))
    elif a.do == "vote":
        engine.vote(a.sql)
    elif a.do == "warm-cycle":
        now = a.now or int(time.time())
        print({f: len(done) for f, done in engine.warm_cycle(TimeRange(now - a.days * DAY, now), now=now).items()})
    elif a.do == "flush":
        print(engine.store.flush(family_prefix=a.prefix))
    else:
        print(engine.store.size())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
