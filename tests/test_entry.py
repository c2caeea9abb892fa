"""The driver's contract, for whatever queries there are."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftgraph.plans.lineage import CLEAN_UP, discard, materialize, materialize_all

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    q = entry.queries()
    assert q and set(entry.oracle_sql()) <= set(q)


def test_tables_in_the_shared_folder(spark, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    other = str(tmp_path / f"table-{'0' * 32}")
    spark.range(5).write.parquet(other)
    before = set(folder.iterdir())
    made = materialize(spark.range(10).groupBy("id").count())
    both = made.unionByName(spark.read.parquet(other).withColumn("count", F.lit(1).cast("bigint")))
    assert both.count() == 15 and len(set(folder.iterdir()) - before) == 1
    discard(both)
    assert set(folder.iterdir()) == before and spark.read.parquet(other).count() == 5  # what others wrote stays
    assert spark.conf.get(CLEAN_UP) == "false"
    parts = materialize_all(spark.range(n) for n in (3, 0, 4))
    assert sorted(r[0] for r in parts.collect()) == [0, 0, 1, 1, 2, 2, 3]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = sorted(map(repr, (tuple(r) for r in entry.queries()[name](spark, SF).select(*names).collect())))
    assert got == want
