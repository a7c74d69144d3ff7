"""Parts of edited reads against the kernels that walk one read, and what their queries' plans move."""

import random

import pytest

from strandmill.functions import read_ops as ro
from strandmill.operators import reads as rd
from strandmill.sources import projection as pj
from tests.test_read_operators import made


def test_reference_equals_its_formula_without_a_step_for_each_base(spark):
    cases = [(low, n) for low in (-64, -3, 0, 166, 167, 231, 5000, 48_000_000) for n in (-1, 0, 1, 40, 231, 232, 700)]
    df = spark.createDataFrame(cases, "low long, n int").withColumn("seq", pj.reference("low", "n"))
    base = lambda q: "ACGT"[(q * q // 7 + q // 3 * 5) % 11 % 4]
    for r in df.collect():
        assert r.seq == "".join(base(p + 64) for p in range(r.low, r.low + max(r.n, 0)))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_adapters_equal_the_walk_over_places():
    rng = random.Random(5)
    for _ in range(6000):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60)))
        mate = rng.choice((1, 2))
        for _ in range(rng.randint(0, 2)):
            a = rng.choice(ro.ADAPTERS[mate])
            a = "".join(rng.choice("ACGT") if rng.random() < 0.1 else x for x in a)[: rng.randint(3, 15)]
            j = rng.choice((rng.randint(0, len(seq)), max(0, len(seq) - len(a))))
            seq = (seq[:j] + a + seq[j + len(a) :]) if rng.random() < 0.5 else seq[:j] + a
        assert ro.first_adapter(seq, mate) == ro.adapter_start(seq, ro.ADAPTERS[mate])


def test_parts_equal_kernels(spark):
    rng = random.Random(7)
    rows = []
    for i, pos, end, cigar, bases, quals, start, ref in made(400, 11):
        if i % 3 == 0:
            bases = bases[: len(bases) // 2] + ro.ADAPTERS[1][0][: len(bases) - len(bases) // 2]
            bases += "A" * (len(quals) - len(bases))
        if i % 5 == 0:
            ref = (ref[:4] * 40)[: len(ref)] if i % 2 else ref[:40]
            bases = bases.lower() if i % 2 else bases
        rows.append((i, pos, end, cigar, bases, quals, start, ref, 1 + i % 2, i % 4 == 0, rng.randint(5, 40), rng.randint(40, 70)))
    rows.append((1000, 5, 5, "", "", "", 0, "", 1, False, 20, 30))
    df = spark.createDataFrame(rows, "rid int, pos int, end_pos int, cigar string, bases string, quals string, ref_start int, ref string, mate int, reverse boolean, start int, stop int")
    for part in ("near", "adapter", "ends"):
        got = {r.rid: r for r in rd.edited(df, part).collect()}
        assert len(got) == len(rows)
        for i, pos, _, cigar, bases, quals, r0, ref, mate, reverse, start, stop in rows:
            g, read = got[i], ro.Read(pos, tuple((op, int(n)) for n, op in rd.ro_split(cigar)), bases, quals)
            if part == "near":
                near = ro.trim_to(read, start - 10, stop + 9)
                assert (g.near_pos, g.near_bases) == ((near.pos, near.bases) if cigar else (None, None))
            elif part == "adapter":
                cut = ro.trim_adapter(read, mate, reverse)
                assert (g.adapter_at, g.adapter_cigar, g.adapter_bases) == ((len(bases) - len(cut.bases), rd.cigar_text(cut.cigar), cut.bases) if cigar else (None,) * 3)
            else:
                assert g.largest_ends == (ro.largest_end_matches(read, ref, r0) if cigar else None)


@pytest.mark.parametrize("name", ["scl_01", "scl_16"])
def test_no_bases_are_shuffled(spark, name, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_ship", lambda context: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = plan.toString()
    join = text[text.index("Join Inner") :]
    assert "repeat(" not in join and "substring(" not in join
