"""SNPs reach as far as the loci do, whatever the number of parts."""

import random

from strandmill.plans import registry
from strandmill.sources import projection as pj


def test_snps_cover_all_loci(spark, tmp_path):
    rng = random.Random(5)
    parts = [(k, "p", 1 + k % 20) for k in range(1000)]
    orders = [(k, rng.randrange(50)) for k in range(7000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = {(f"s{c % 5}", f"chr{k % 4 + 1}", k * 7 % 40_000) for k, c in orders}
    assert {tuple(r) for r in pj.het_snps(spark, str(tmp_path)).collect()} == want and max(x[2] for x in want) > 39_000
    near = {(k, s, p) for k, _, z in parts for s, c, p in want if c == f"chr{k % 4 + 1}" and k * 40 - 101 < p < k * 40 + 10 + z + 100}
    got = {tuple(r) for r in registry.queries()["join_07"](spark, str(tmp_path)).select("locus", "sample", "snp_pos").collect()}
    assert got == near and {x[0] for x in got} == set(range(1000))
