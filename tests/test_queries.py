"""Every query of the core library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from mnemospark.plans import record_queries, rule_queries, stream_queries
from mnemospark.plans.rule_queries import O, Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

assert record_queries and rule_queries and stream_queries
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{float(v):.6f}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, con, name):
    df = Q[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in O:
        return
    rel = con.sql(O[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["j06_operator_dedup", "j08_verify_beliefs", "j01_keyword_search", "j09_similar_entities"])
def test_no_nested_loop(spark, name):
    plan = Q[name](spark, D)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_splits_partition_the_input(spark):
    from mnemospark.operators.curate import split_archive, split_expired
    from mnemospark.plans.fixtures import AS_OF, mem

    m = mem(spark, D)
    for a, b in (split_expired(m, AS_OF), split_archive(m)):
        assert a.count() + b.count() == m.count() and a.join(b, "mid").count() == 0


def test_upsert_is_idempotent(spark):
    from mnemospark.plans.fixtures import mem
    from mnemospark.sources.io import upsert
    from pyspark.sql import functions as F

    m = mem(spark, D).select("mid", "content").withColumn("seq", F.lit(1))
    new = m.where("mid % 2 = 0").withColumn("content", F.lit("x"))
    once = upsert(m, new)
    assert sorted(map(tuple, upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_routers_search_pending_rows(spark):
    """The pending channel of the routers reads all records, as j04_pending_search does."""
    n = {r.qid: r.pending for r in Q["g08_route_stats"](spark, D).collect()}
    alone = {r.qid: r["count"] for r in Q["j04_pending_search"](spark, D).groupBy("qid").count().collect()}
    assert n and any(n.values()) and all(v in (0, alone.get(q, 0)) for q, v in n.items())


def test_pending_rows_meet_queries_without_a_shuffle_of_pairs(spark):
    """Rows and queries meet in blocks: above them nothing is grouped or joined, and each pair comes once."""
    found = Q["j04_pending_search"](spark, D)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not any(x in plan.partition("FlatMapGroupsInArrow")[0] for x in ("Aggregate", "Join"))
    assert found.count() == found.select("qid", "mid").distinct().count() > 0
