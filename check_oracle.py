"""Compare registered queries with DuckDB: python check_oracle.py [folder] [name prefix ...]"""

import sys
import time

from soundcheck.catalog.base import ORACLE, QUERIES
from soundcheck.session import local_session
from tests.oracle import compare, connect


def main() -> int:
    import soundcheck.catalog  # noqa: F401 - registers the queries
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con, bad = local_session(), connect(folder), 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            if name in ORACLE:
                problems, kind = compare(spark, con, name, folder), "same"
            else:
                rows = QUERIES[name](spark, folder).collect()
                problems, kind = ([] if rows else ["no rows"]), f"{len(rows)} rows, no oracle"
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:34s} {time.time() - started:6.2f}s {'; '.join(problems) or kind}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
