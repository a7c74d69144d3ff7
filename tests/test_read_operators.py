"""Column forms of read operators against the kernels that walk one read, and ranks and range counts by bins."""

import random

from pyspark.sql import functions as F

from strandmill.functions import kernels as k
from strandmill.functions import read_ops as ro
from strandmill.operators import ranges
from strandmill.operators import reads as rd


def made(n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ref = "".join(rng.choice("ACGT") for _ in range(120))
        ops = [(rng.choice("SH") if rng.random() < 0.3 else "", rng.randint(1, 4)), ("M", rng.randint(1, 30))]
        for _ in range(rng.randint(0, 2)):
            ops += [(rng.choice("ID"), rng.randint(1, 5)), ("M", rng.randint(1, 30))]
        ops = [x for x in [*ops, (rng.choice("S") if rng.random() < 0.3 else "", rng.randint(1, 4))] if x[0]]
        at, bases = 10, ""
        for op, m in ops:
            if op == "M":
                bases += ref[at : at + m]
            elif op in "IS":
                bases += "".join(rng.choice("ACGT") for _ in range(m))
            at += m if op in "MD" else 0
        if rng.random() < 0.4 and bases:
            j = rng.randrange(len(bases))
            bases = bases[:j] + "N" + bases[j + 1 :]
        quals = "".join(rng.choice("!#5I") if rng.random() < 0.2 else "I" for _ in bases)
        rows.append((i, 10, at, "".join(f"{m}{op}" for op, m in ops), bases, quals, 0, ref))
    return rows


def test_columns_equal_kernels(spark):
    rows = made()
    df = spark.createDataFrame(rows, "rid int, pos int, end_pos int, cigar string, bases string, quals string, ref_start int, ref string")
    left, right = rd.low_quality_ends(F.col("quals"))
    before, behind = rd.before_indel(F.col("cigar"))
    ends = rd.ends_match(*(F.col(c) for c in ("cigar", "bases", "pos", "end_pos", "ref", "ref_start")))
    got = {r.rid: r for r in df.select("rid", left.alias("l"), right.alias("r"), before.alias("b"), behind.alias("e"), ends.alias("m"), rd.unclipped_bases(F.col("cigar"), F.col("bases")).alias("u")).collect()}
    for i, pos, _, cigar, bases, quals, start, ref in rows:
        read = ro.Read(pos, tuple((op, int(n)) for n, op in rd.ro_split(cigar)), bases, quals)
        g = got[i]
        assert (g.l, g.r) == k.trim_by_quality(bases, quals)
        assert (g.b, g.e) == ro.distance_to_indel(read.cigar)
        assert g.m == (min(ro.matches_at_ends(read, ref, start)) >= rd.END_MATCHES)
        assert g.u == ro.unclipped(read)[2]


def test_edited_rows(spark):
    rows = [(*r, 1, False, 20, 30, [12, 500]) for r in made(40, 3)]
    rows.append((99, 5, 5, "", "", "", 0, "", 1, False, 20, 30, None))
    schema = "rid int, pos int, end_pos int, cigar string, bases string, quals string, ref_start int, ref string, mate int, reverse boolean, start int, stop int, at array<int>"
    got = {r.rid: r for r in rd.edited(spark.createDataFrame(rows, schema)).collect()}
    assert got[99].low_bases is None and len(got) == len(rows)
    for i, pos, _, cigar, bases, quals, *_ in rows[:-1]:
        read = ro.Read(pos, tuple((op, int(n)) for n, op in rd.ro_split(cigar)), bases, quals)
        assert got[i].low_bases == ro.trim(read, *k.trim_by_quality(bases, quals)).bases
        assert got[i].length_change == ro.length_change(read, 20, 30) and got[i].snp_bases[1] == "-"


def test_ranks_and_counts(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randrange(-50, 400), i) for i in range(300)]
    loci = [(i, rng.choice("abc"), rng.randrange(0, 300)) for i in range(60)]
    df = spark.createDataFrame(points, "chrom string, pos int, id int")
    for width in (7, 64, 1 << 16):
        ranked = {r.id: r.ord for r in ranges.rank_by_position(df, ["chrom"], "pos", ["id"], width=width).collect()}
        for c in "ab":
            own = sorted((p, i) for x, p, i in points if x == c)
            assert [ranked[i] for _, i in own] == list(range(1, len(own) + 1))
        n = {r.locus: r.n for r in ranges.count_within(spark.createDataFrame(loci, "locus int, chrom string, start int"), df, ["chrom"], "locus", "start", "pos", 30, width).collect()}
        assert n == {i: sum(x == c and abs(p - s) <= 30 for x, p, _ in points) for i, c, s in loci}


def test_tags_of_mates(spark):
    rows = [("r1", "s", "n1", 1), ("r2", "s", "n1", 1), ("r3", "s", "n2", 1), ("r4", "s", "n2", 2), ("r5", "s", "n3", 2), ("r6", "s", "n3", None), ("r7", "s", "n4", 2)]
    got = {r.rid: (r.p1, r.p2) for r in rd.tagged_phases(spark.createDataFrame(rows, "rid string, sample string, rname string, hp int")).collect()}
    one, two, none = (-0.01, -1000.0), (-1000.0, -0.01), (0.0, 0.0)
    assert got == {"r1": one, "r2": one, "r3": none, "r4": none, "r5": none, "r6": none, "r7": two}
