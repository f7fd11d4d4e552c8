"""Run registered queries from one name on (or the named ones) against DuckDB."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import harness  # noqa: E402

import tidemark.plans.queries as registered  # noqa: E402

folder = f"{harness.DATA}/{os.environ.get('SF', 'sf0.01')}"
spark, con = harness.session(), harness.database(folder)
names = list(registered.REGISTRY)
picked = []
for a in sys.argv[1:]:
    picked += names[names.index(a[:-1]):] if a.endswith("+") else [a]
bad = []
for n in picked or names:
    q, sql = registered.REGISTRY[n]
    try:
        ok, text = harness.compare(spark, con, folder, n, q, sql)
    except Exception as problem:
        ok, text = False, f"{type(problem).__name__}: {str(problem)[:1500]}".replace("\n", " ")
    print("\n" + ("ok  " if ok else "FAIL"), n, text, flush=True)
    bad += [] if ok else [n]
print(len(bad), "failed", bad)
