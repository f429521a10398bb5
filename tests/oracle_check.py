"""Run registered queries against their SQL: python tests/oracle_check.py [folder] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from kodagraf.runtime import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    plan = df._jdf.queryExecution().executedPlan().toString()
    flags = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
    if flags:
        print("    plan of", name, "has", *flags)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no SQL)"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = sorted_rows(cols, res.fetchall())
    note = f"rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s duckdb={time.time() - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note} columns {sorted(df.columns)} / {sorted(cols)}"
    if repr(got) != repr(want):
        got_set, want_set = {repr(r) for r in got}, {repr(r) for r in want}
        only_got = [r for r in got if repr(r) not in want_set][:3]
        only_want = [r for r in want if repr(r) not in got_set][:3]
        return False, f"{note}\n   spark only {only_got}\n   sql only   {only_want}"
    return True, note


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; failing: {bad}")


if __name__ == "__main__":
    main()
