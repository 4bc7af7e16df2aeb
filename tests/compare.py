"""Run registered queries next to their SQL in DuckDB: same rows, columns and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(query, sql, spark, con, sf_dir) -> str | None:
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    theirs = normal([d[0] for d in relation.description], relation.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} <> {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows <> {len(theirs[1])}; " + str(
            list(set(map(repr, mine[1])) ^ set(map(repr, theirs[1])))[:4]
        )
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(mine[1])} rows differ, first {mine[0]} {bad[0]}" if bad else None


def main():
    from matchspark.plans import registered
    from matchspark.session import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = registered()
    con = connect(sf_dir)
    for name in names or queries:
        start = time.time()
        try:
            if name in oracle:
                result = difference(queries[name], oracle[name], spark, con, sf_dir) or "ok"
            else:
                result = f"{len(queries[name](spark, sf_dir).collect())} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
