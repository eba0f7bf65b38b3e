"""Compare every registered query with its DuckDB oracle (driver-style check).

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from oracle_util import compare, duck  # noqa: E402

from credrisk.plans.catalog import ORACLE, QUERIES, load_all  # noqa: E402
from credrisk.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    load_all()
    spark = local_session()
    con = duck(sf)
    bad = 0
    for name in sorted(QUERIES):
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                ok, msg = compare(df, ORACLE[name], con)
            else:
                n = df.count()
                ok, msg = True, f"rows-only: {n} rows"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t:6.2f}s  {msg}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
