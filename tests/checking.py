"""Compare a registered query with its SQL, row by row."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """Differences as text, empty if the results are equal."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    result = con.execute(sql)
    theirs = rows([c[0] for c in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        mine, other = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"{len(ours[1])} / {len(theirs[1])} rows, only here {sorted(mine, key=repr)[:3]}, only there {sorted(other, key=repr)[:3]}"
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracle_sql():
                problem = compare(spark, con, sf_dir, query, oracle_sql()[name])
            else:
                problem = f"(rows only: {query(spark, sf_dir).collect()[:2]})"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {problem or 'equal'} [{time.time() - start:.1f}s]", flush=True)
