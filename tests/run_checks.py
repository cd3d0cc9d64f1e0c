"""``python -m tests.run_checks [sf] [name ...]``: every registered query against its SQL."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as contract
from parley.session import local_session
from tests.compare import differences, duck


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8", "checks")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracles:
                problem = differences(frame, connection, oracles[name])
                rows = ""
            else:
                problem, rows = None, f" rows={frame.count()} (no SQL)"
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s{rows}", flush=True)
        if problem:
            print("     ", problem[:3000], flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
