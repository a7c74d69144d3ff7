"""Posteriors keep a group in one row until it is normalised; PL rounds as its SQL does."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strandmill.operators import aggregates as agg
from strandmill.plans import registry


def test_pl_just_below_a_half_equals_sql(spark, tmp_path):
    rows = [(14, 3395, 4), (49, 3825, 6), (48, 3455, 7), (8, 3195, 2), (13, 3965, 4), (33, 3290, 6), (38, 3235, 4), (34, 3515, 4), (8, 3295, 5)]
    day = datetime.datetime(1995, 1, 1)
    lines = [{"l_orderkey": k, "l_partkey": 79611, "l_suppkey": s, "l_linenumber": n, "l_quantity": float(q), "l_extendedprice": 1.0, "l_returnflag": "R", "l_linestatus": "O", "l_shipdate": day} for k, (q, s, n) in enumerate(rows)]
    pq.write_table(pa.Table.from_pylist(lines, pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string()), ("l_shipdate", pa.timestamp("us"))])), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array([79611], pa.int64()), "p_name": ["x"], "p_size": pa.array([3], pa.int32())}), tmp_path / "part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()["agg_12"]).fetchall()
    assert [tuple(r) for r in registry.queries()["agg_12"](spark, str(tmp_path)).collect()] == want == [(79611, "s0", "202,0,18,145,13,228")]


def test_genotypes_are_not_shuffled(spark):
    reads = spark.createDataFrame([(k % 3, f"s{k % 2}", k) for k in range(40)], "locus long, sample string, x long")
    post = agg.genotype_posteriors(reads, 3, lambda a: -F.abs(F.col("x") % 5 - a).cast("double"))
    assert abs(post.groupBy("locus", "sample").agg(F.sum(F.exp("lp")).alias("p")).agg(F.max(F.abs(F.col("p") - 1))).first()[0]) < 1e-12
    best = agg.best_genotype(post)
    best.collect()
    assert best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
