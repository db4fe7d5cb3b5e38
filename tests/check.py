"""Run registered queries against their SQL: python tests/check.py SF [name-prefix ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from oracle import compare, connect  # noqa: E402

from tickloom.session import local_session  # noqa: E402


def main() -> None:
    import __spark_entry__ as entry

    sf, prefixes = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            ok, why = compare(spark, con, name, fn, sql, sf_dir) if sql else (True, f"no sql, {fn(spark, sf_dir).count()} rows")
        except Exception as e:  # report and go on with the next query
            ok, why = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {why}", flush=True)
    print("failures:", bad)


main()
