"""`python tests/run_checks.py [sf_dir] [name-part ...]`: compare queries with their checking SQL."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from engram.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = 0
    begin = time.time()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, checks.get(name))
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "why": "".join(traceback.format_exception_only(type(e), e))[:1500], "sec": 0, "rows": -1}
            if "-v" in sys.argv:
                traceback.print_exc()
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]]
        bad += r["ok"] is False
        print(mark, f"{r['sec']:6.2f}s", f"{r['rows']:7d}", name, r.get("types", ""), r["why"][:900], flush=True)
    print(f"{bad} failures, {time.time() - begin:.0f}s")


main()
