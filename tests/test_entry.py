import duckdb

import __spark_entry__ as entry
from leafmill.plans import queries as own

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_against_its_sql(spark):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    key = lambda rows: sorted(map(repr, rows))
    for name, query in own.QUERIES.items():
        got = query(spark, SF)
        columns = sorted(got.columns)
        rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
        if name in own.ORACLE_SQL:
            want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({own.ORACLE_SQL[name]})").fetchall()
            assert key(rows) == key(want), name
        else:
            assert rows, name
