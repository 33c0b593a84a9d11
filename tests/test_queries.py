"""Every registered query with SQL, on Spark and on DuckDB, row by row."""

import math
import os

import duckdb
import pytest
from docassay.plans import registry

LARGER = "/root/testdata/sf0.01"  # for queries that find nothing in the smallest tables
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    def connect(folder):
        con = duckdb.connect()
        con.sql("set timezone = 'UTC'")
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return con

    return {folder: connect(folder) for folder in (DIR, LARGER)}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo") and v is not None:
        return str(v.replace(tzinfo=None))
    return v if isinstance(v, (str, int, bool, type(None))) else float(v) if type(v).__name__ == "Decimal" else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    folder = DIR
    want = duck[DIR].sql(registry.ORACLE_SQL[name])
    rows = want.fetchall()
    if not rows:
        folder = LARGER
        want = duck[LARGER].sql(registry.ORACLE_SQL[name])
        rows = want.fetchall()
    df = registry.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(want.columns)
    got, rows = table(df.columns, df.collect()), table(want.columns, rows)
    assert len(got) == len(rows)
    assert rows, "nothing is compared"
    wrong = [(a, b) for a, b in zip(got, rows) if a != b]
    assert not wrong, f"{len(wrong)} of {len(got)}: {wrong[:3]}"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


#: Rows that share an id (as many of them as here, which fall into one mean or two), blank texts, and signs that are no space.
ODD_TEXTS = [
    (0, None), (1, ""), (2, " "), (3, "\n \n  "), (4, "a"), (5, " a  b \n\nc\n"), (6, "\t"), (7, "a\tb \r\n c"), (8, "\u00a0 \u3000a x\u0085y"), (9, "\U0001f600 \U0001f600\U0001f600 \u00e9 e\u0301"),
    (10, "a bb"), (10, "a bb"), (11, "a"), (11, "bbbbbbb cc"), (11, None), (12, ""), (12, "abc d"), (13, ""), (13, None), (None, "a b"), (None, "c"), (14, "ab " * 30000),
]


def test_blocks_of_odd_documents(spark, tmp_path):
    """F1 of round 4: documents without words had a row of none, and rows that share an id were summed by their mean."""
    spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["S12_ocr_blocks_flatten"])
    df = registry.QUERIES["S12_ocr_blocks_flatten"](spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "mean_confidence": "int", "n": "bigint", "last": "int"}
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())
