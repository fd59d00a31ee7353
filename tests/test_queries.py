"""Every registered query against its oracle, and what its plan must not hold."""

import contextlib
import io
import math

import duckdb
import pytest

from tests.conftest import SF_DIR
from titleloom.queries import ORACLES, QUERIES
from titleloom.queries.base import TABLES

PREFIXES = [f"{f}{n}_" for f, last in (("s", 9), ("t", 22), ("f", 8), ("j", 14), ("a", 11), ("w", 9), ("x", 4)) for n in range(1, last + 1)]
STREAMS = [q for q in QUERIES if q.endswith("_stream")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v if v is None or isinstance(v, (bool, int, str)) else str(v)

    return sorted(tuple(map(value, r)) for r in map(tuple, rows)) if not rows else sorted(
        (tuple(map(value, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def test_every_operator_is_registered():
    assert [p for p in [*PREFIXES, "e2_", "e3_"] if not any(q.startswith(p) for q in QUERIES)] == []
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = canonical(df.select(*cols).collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = canonical([tuple(row[names.index(c)] for c in cols) for row in result.fetchall()])
    assert got == want
    assert got, "an empty result checks nothing"


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in STREAMS])
def test_plan_stays_native(spark, name):
    """No Python, no cross join, no nested loops in any batch plan."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        QUERIES[name](spark, SF_DIR).explain()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups", "PythonUDF"):
        assert banned not in text.getvalue(), banned


def test_top_k_is_cut_before_the_shuffle(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        QUERIES["w1_best_per_tier"](spark, SF_DIR).explain()
    plan = text.getvalue()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("lineitem.parquet") == 1


def test_hot_block_is_split(spark):
    """One blocking word holds most titles: adaptive execution splits its partition."""
    from pyspark.sql import functions as F

    from titleloom.operators.link import link_titles

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        titles = spark.range(0, 20_000, 1, 8).select(
            F.when(F.col("id") % 10 < 7, F.concat(F.lit("castle "), F.col("id"))).otherwise(F.concat(F.lit("word"), F.col("id"))).alias("title")
        )
        queries = spark.createDataFrame([("q", "castle"), ("r", "word17777")], "query_id STRING, title STRING")
        pairs = link_titles(queries, titles)
        pairs.collect()
        assert "skew=true" in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.where("query_id = 'q'").count() == 14_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
