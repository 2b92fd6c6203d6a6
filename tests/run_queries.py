"""Run named queries against their SQL: python tests/run_queries.py [-d dir] [name-part ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, difference, session  # noqa: E402


def main(argv: list[str]) -> int:
    path = "/root/testdata/sf0.001"
    if argv[:1] == ["-d"]:
        path, argv = argv[1], argv[2:]
    spark, con = session(), connect(path)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(part in name for part in argv):
            continue
        t0 = time.time()
        try:
            df = fn(spark, path)
            if name in sql:
                problem = difference(df, con, sql[name])
                note = f"{df.count()} rows" if problem is None else problem
            else:
                n = df.count()
                problem, note = (None if n else "no rows"), f"{n} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = note = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - t0:6.2f}s {name}: {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
