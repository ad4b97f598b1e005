"""Compare a Spark result with a DuckDB result, regardless of row order."""

from collections import Counter

import duckdb

TABLES = "region nation customer part orders lineitem".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(columns, records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in records)


def differences(spark_df, relation) -> list[str]:
    found = []
    ours, theirs = spark_df.columns, list(relation.columns)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    names = {"varchar": "string", "integer": "int"}
    types = dict(spark_df.dtypes)
    for name, t in zip(theirs, relation.types):
        t = str(t).lower()
        if types[name] != names.get(t, t):
            found.append(f"type of {name}: {types[name]} != {t}")
    a = rows(ours, [tuple(r) for r in spark_df.collect()])
    b = rows(theirs, relation.fetchall())
    if a != b:
        found.append(f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; "
                     f"only SQL {list((b - a).items())[:3]}")
    return found
