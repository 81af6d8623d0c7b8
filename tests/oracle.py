"""Comparison of the queries with their SQL, run by DuckDB over the same tables."""

import datetime
import decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, con, sql):
    """'' if the query's rows are those of the SQL, else what differs."""
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr)
    if want == got:
        return ""
    bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"{len(got)} rows and {len(want)}; {bad}"
