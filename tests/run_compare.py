"""Prints agreement of all (or the named) queries: python tests/run_compare.py [--sf DIR] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from regionhour import build_session  # noqa: E402
from regionhour.plans import registry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

args = sys.argv[1:]
sf = "/root/testdata/sf0.01"
if args[:1] == ["--sf"]:
    sf, args = args[1], args[2:]
spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
queries, oracles = registry.queries(), registry.oracle_sql()
bad = 0
for name in args or queries:
    began = time.time()
    try:
        df = queries[name](spark, sf)
        verdict = differences(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
    except Exception:
        verdict = traceback.format_exc(limit=-3)[-1500:]
    ok = verdict is None or verdict.startswith("rows only")
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s {verdict or ''}", flush=True)
print(f"{bad} failing of {len(args or queries)}")
