"""Run queries here and their SQL on DuckDB over the same files; compare by value.

    python tests/compare.py [sf_dir] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda r: tuple(map(str, r)))


def equal(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b and (a is None) == (b is None)


def compare(spark, con, query, sql, sf_dir):
    """None where both agree, else the first difference."""
    frame = query(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    want = answer.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(set(frame.columns) ^ set(columns))}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    names = sorted(columns)
    differ, shown = 0, None
    for mine, theirs in zip(normal(got, frame.columns), normal(want, columns)):
        bad = [n for n, a, b in zip(names, mine, theirs) if not equal(a, b)]
        if bad:
            differ += 1
            shown = shown or [
                (n, a, b) for n, a, b in zip(names, mine, theirs) if not equal(a, b)
            ][:4]
    return f"{differ} of {len(got)} rows, {shown}" if differ else None


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from obsweave.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, answers, failed = connect(sf_dir), contract.oracle_sql(), []
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in answers:
                found = compare(spark, con, query, answers[name], sf_dir)
                note = "ok" if found is None else f"DIFFERS {found}"
            else:
                found, note = None, f"{query(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:
            found = note = f"FAILED {str(error)[:600]}"
        if found:
            failed.append(name)
        print(f"{name:24s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
