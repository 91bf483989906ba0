"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from skylattice import image_queries, queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


assert image_queries.QUERIES is own.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(own.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    want = duck.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({own.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()]
    assert sorted(repr(plain(r)) for r in got) == sorted(repr(plain(r)) for r in want)


def test_a_wrong_oracle_is_noticed(spark, duck):
    with pytest.raises(AssertionError):
        sql = own.ORACLE_SQL["f4_altitude"]
        own.ORACLE_SQL["f4_altitude"] = sql.replace("13000", "13100")
        try:
            test_same_rows(spark, duck, "f4_altitude")
        finally:
            own.ORACLE_SQL["f4_altitude"] = sql


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["image_id", "mAltitude", "imuGyroMag", "order"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
