"""Run a named query in both engines and compare all rows."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, query, sql, sf_dir):
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    found = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    wanted = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if found != wanted:
        return (
            f"{sum(found.values())} rows against {sum(wanted.values())};"
            f" only Spark {list((found - wanted).items())[:3]};"
            f" only SQL {list((wanted - found).items())[:3]}"
        )
    return None if found else "no rows"
