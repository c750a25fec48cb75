"""Compare a registered query with its SQL in DuckDB on the same tables, as unordered rows with columns by name."""

import math
from collections import Counter
from pathlib import Path


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    if type(x).__name__ == "Row":
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_duck(con, sql):
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


#: Types that hold the same values, as DuckDB names them.
SAME = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "long", "hugeint": "long", "float": "double", "string": "varchar", "varchar": "varchar", "timestamp_ntz": "timestamp", "binary": "blob"}


def kind(t):
    t = t.lower()
    return "double" if t.startswith("decimal") else SAME.get(t, "nested" if any(x in t for x in "[(<") else t)


def compare(spark, name, query, sql, sf_dir, con=None):
    df, con = query(spark, sf_dir), con or duck(sf_dir)
    a, b = rows_of_spark(df), rows_of_duck(con, sql)
    assert a[0] == b[0], f"{name}: columns {a[0]} and {b[0]}"
    mine, theirs = {c: kind(t) for c, t in df.dtypes}, {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert mine == theirs, f"{name}: types {sorted(set(mine.items()) ^ set(theirs.items()))}"
    if a[1] != b[1]:
        left, right = list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3]
        raise AssertionError(f"{name}: {sum(a[1].values())} and {sum(b[1].values())} rows; only Spark: {left}; only DuckDB: {right}")
    return sum(a[1].values())
