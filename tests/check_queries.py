"""Developer tool: compare registered queries with their SQL. Usage: check_queries.py SF PREFIX..."""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402
from tapewright.session import build_session  # noqa: E402


def main() -> None:
    sf, *prefixes = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                verdict = compare(df, con, sqls[name]) or f"ok {df.count()} rows"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:36s} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
