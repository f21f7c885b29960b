"""Local correctness check: every registered query vs its oracle SQL.

usage: python scripts/check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from corridor.checks.compare import compare, duck  # noqa: E402
from corridor.registry import oracle_sql, queries  # noqa: E402
from corridor.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t = time.time()
        try:
            res = compare(fn(spark, sf_dir), sqls.get(name), con)
        except Exception as e:  # report and go on
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}"}
        res["sec"] = round(time.time() - t, 2)
        ok = res.get("match", "error" not in res and name not in sqls)
        bad += not ok
        print(("OK  " if ok else "BAD ") + name, json.dumps(res, default=str)[:600], flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
