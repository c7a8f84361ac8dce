from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vdomain import queries
from vdomain.kernel.sw import local_identity, local_score


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 1501).select(F.col("id").alias("o_orderkey")).write.parquet(f"{path}/orders.parquet")
    spark.range(1, 201).select(F.col("id").alias("p_partkey")).write.parquet(f"{path}/part.parquet")
    return path


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert Counter(repr(tuple(r)) for r in df.collect()) == Counter(map(repr, rel.project(", ".join(df.columns)).fetchall()))


def test_sequences_grow_with_the_orders(spark, sf):
    rows = queries.made_sequences(spark, sf).collect()
    assert len(rows) == 1500 and len({r.sequence for r in rows}) > 1490


def test_long_loops_of_all_heavy_orders(spark, sf):
    heavy = {r.o_orderkey for r in queries.made_sequences(spark, sf).where("chain = 'H'").collect()}
    got = queries.long_cdr3_rescue(spark, sf).collect()
    assert len(heavy) > 200 and len(got) == len(heavy) and {r.o_orderkey for r in got} == heavy
    assert all(r.length == 98 + 60 + 14 for r in got)
    assert sum(r.query_end == r.length for r in got) > 0.95 * len(got)


def test_whole_sequences_are_aligned(spark, sf):
    rows = queries.sw_scores(spark, sf).collect()
    assert len(rows) == 200 and all(len(r.a) == len(r.b) == 32 for r in rows) and len({r.b for r in rows}) == 200
    for r in rows[:50]:
        assert r.score == local_score(r.a, r.b) and r.identity == local_identity(r.a, r.b)[0]


@pytest.mark.parametrize("name", ["annotate_end_to_end", "annotate_calls"])
def test_like_sequences_are_annotated_together(spark, sf, name):
    """Rows are dealt out by ranges of their sequences and pass through the scan, so nothing is joined back."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(length(sequence" in plan and "SortMergeJoin" not in plan
