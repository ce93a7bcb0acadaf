"""Run every registered query (or those named) against its SQL: python tests/check_all.py [sf_dir] [names...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from quayside.catalog import ORACLE, QUERIES  # noqa: E402
from quayside.session import build  # noqa: E402


def main(sf_dir, names):
    spark = build("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                rows, problems = compare(df, con, ORACLE[name])
            else:
                rows, problems = len(df.collect()), []
        except Exception as error:  # noqa: BLE001
            rows, problems = 0, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        kind = "sql " if name in ORACLE else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name} rows={rows} {time.time() - start:.2f}s", *problems, flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
