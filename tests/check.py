"""Run registered queries against their SQL: python tests/check.py DIR [name-part ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import oracle  # noqa: E402
from conftest import session  # noqa: E402

from vdjloom import catalog  # noqa: E402


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = session(), oracle.connect(sf_dir)
    bad = 0
    for name, (run, sql) in catalog.load().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if sql:
                df = run(spark, sf_dir)
                names, ours = oracle.run_spark(df)
                spark_time = time.time() - start
                result = oracle.difference(names, ours, con, sql)
                size = sum(ours.values())
            else:
                size = len(run(spark, sf_dir).collect())
                spark_time = time.time() - start
                result = ""
        except Exception as e:
            traceback.print_exc(limit=4)
            result, spark_time, size = f"ERROR {str(e)[:600]}", time.time() - start, -1
        bad += bool(result)
        print(f"{'FAIL' if result else ('ok  ' if sql else 'rows')} {name} rows={size} "
              f"spark={spark_time:.1f}s all={time.time() - start:.1f}s {result}", flush=True)
        spark.catalog.clearCache()
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
