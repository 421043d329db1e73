"""Every query that has SQL against DuckDB on the smallest tables; those of the training-data part run in tests/llm."""

import math

import pytest

from pyspark.sql import functions as F

from graphloom.functions import extract
from graphloom.operators import ingest
from graphloom.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_shared_basenames_of_a_full_directory(spark, tmp_path):
    """Directories of up to 20 files are paired, fuller ones are not, at any number of files; without a limit all are."""
    spark.range(3000).selectExpr("id AS doc_id", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["shared_basename_pairs"](spark, str(tmp_path)).select("a", "b").collect()))
    assert len(got) == 50 * 30 and got == sorted(c.execute(ORACLES["shared_basename_pairs"]).fetchall())
    files = spark.range(300).selectExpr("concat('d/f', cast(floor(id / 3) AS bigint), '.', element_at(array('ts', 'py', 'go'), cast(id % 3 + 1 AS int))) AS path")
    files = files.withColumn("language", extract.language(F.col("path")))
    assert ingest.shared_names(files).count() == 0 and ingest.shared_names(files, None).count() == 300


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
