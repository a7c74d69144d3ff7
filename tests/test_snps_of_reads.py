"""Reads and the SNPs between their ends, one row a read; PSNP with reads of equal ids, without a shuffle of bases."""

import random

import duckdb

from strandmill.operators import joins
from strandmill.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_every_read_has_its_snps_once(spark):
    rng = random.Random(5)
    reads = [(n, rng.choice(["a", "b", None]), rng.choice(["chr1", "chr2"]), p, p + rng.choice([0, 5, 90, 3000])) for n in range(300) for p in [rng.randint(-50, 6000)]]
    snps = list({(rng.choice(["a", "b"]), rng.choice(["chr1", "chr2", "chr3"]), rng.randint(-60, 8000)) for _ in range(400)})
    r = spark.createDataFrame(reads, "rid long, sample string, chrom string, pos long, end_pos long")
    v = spark.createDataFrame(snps, "sample string, chrom string, pos long")
    for width in (1024, 64):
        got = joins.snps_of_reads(r, v, width).select("rid", "snps").collect()
        assert len(got) == len(reads)
        for row in got:
            _, sample, chrom, low, high = reads[row.rid]
            assert sorted(row.snps or []) == sorted(p for s, c, p in snps if (s, c) == (sample, chrom) and low <= p <= high)
    assert joins.snps_of_reads(r.limit(0), v).count() == 0 and joins.snps_of_reads(r, v.limit(0)).count() == len(reads)


def test_reads_of_equal_ids_count_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.sql(f"create view {t}_0 as select * from '{SMALL}/{t}.parquet'")
    con.sql("create table lineitem as select * from lineitem_0 union all select * replace (l_quantity + 1 as l_quantity) from lineitem_0 where l_orderkey % 3 = 0")
    for t in ("part", "orders"):
        con.sql(f"create table {t} as select * from {t}_0")
    for t in ("lineitem", "part", "orders"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = registry.queries()["prj_04"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(registry.oracle_sql()["prj_04"]).fetchall())
    # Reads are shuffled once, to the SNPs, and neither by their ids nor with their bases.
    assert "hashpartitioning(rid" not in got._jdf.queryExecution().executedPlan().toString()
