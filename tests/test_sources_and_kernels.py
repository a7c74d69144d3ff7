import gzip
import math
import random
import struct
import time

import numpy as np
import pytest

from strandmill.functions import genetics as g
from strandmill.functions import kernels as k
from strandmill.operators import joins, models
from strandmill.sources import bam, text, vcf_writer


def put(path, content):
    path.write_text(content)
    return str(path)


def test_regions_pedigree_and_models(spark, tmp_path):
    bed = put(tmp_path / "a.bed", "chr1 11 20 3 3.3 x\n\nchr2\t5\t9\t2\t2.0\n")
    rows = sorted(map(tuple, text.read_regions(spark, bed).collect()))
    assert rows == [("chr1", 10, 20, 3, "x"), ("chr2", 4, 9, 2, None)]
    assert text.read_regions(spark, bed, "chr2").count() == 1
    for bad in ("chr1 0 20 3 1", "chr1 30 20 3 1", "chr1 3 20 10 1", "chr1 3 20 x 1"):
        with pytest.raises(Exception, match="bad region"):
            text.read_regions(spark, put(tmp_path / "b.bed", bad)).collect()
    ped = put(tmp_path / "p.fam", "f c d m 1\nf d 0 0\n")
    assert [tuple(r) for r in text.read_pedigree(spark, ped).collect()] == [("f", "c", "d", "m"), ("f", "d", None, None)]
    m = put(tmp_path / "m.tsv", "chr1\t10\t20\t0.9\t0.1\t0.1\t0.8\t0.01\t0.01\t3\n")
    models_df = text.read_stutter_models(spark, m)
    text.write_stutter_models(models_df, str(tmp_path / "out"))
    assert text.read_stutter_models(spark, str(tmp_path / "out")).collect() == models_df.collect()


SAM = "@SQ\tSN:chr1\tLN:1000\n@RG\tID:g\tSM:s\tLB:l\nr1\t99\tchr1\t11\t60\t3M2I4M1D3S\t=\t50\t9\tACGTACGTACGT\tIIIIIIIIIIII\tRG:Z:g\tAS:i:9\n"


def test_sam_and_bam_agree(spark, tmp_path):
    row = text.read_sam(spark, put(tmp_path / "a.sam", SAM)).first()
    assert (row.name, row.flag, row.chrom, row.pos, row.end_pos, row.mate_chrom, row.mate_pos, row.tags) == ("r1", 99, "chr1", 10, 18, "chr1", 49, {"RG": "g", "AS": "9"})
    assert [tuple(r)[1:] for r in text.read_groups(spark, str(tmp_path / "a.sam")).collect()] == [("g", "s", "l")]
    contigs = text.read_contigs(spark, str(tmp_path / "a.sam"))
    assert contigs.first().length == 1000 and text.differing_contigs(contigs).count() == 0
    cigar = [(3, "M"), (2, "I"), (4, "M"), (1, "D"), (3, "S")]
    bases = [("=ACMGRSVTWYHKDBN".index(c)) for c in "ACGTACGTACGT"]
    body = struct.pack("<iiBBHHHiiii", 0, 10, 3, 60, 0, len(cigar), 99, 12, 0, 49, 9) + b"r1\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
    body += bytes(a << 4 | b for a, b in zip(bases[::2], bases[1::2], strict=True)) + bytes([40] * 12) + b"RGZg\0ASC\x09"
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:30]) + gzip.compress(raw[30:]))
    other = bam.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert other.asDict() | {"file": 0} == row.asDict() | {"file": 0}
    (tmp_path / "cut.bam").write_bytes(gzip.compress(raw[:-3]))
    with pytest.raises(Exception, match="cut off"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def test_fasta_windows(spark, tmp_path):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(500))
    fa = put(tmp_path / "a.fa", ">chr1 some\n" + "\n".join(seq[i : i + 60] for i in range(0, 500, 60)).lower() + "\n>chr2\nACGT\n")
    pieces = text.read_fasta(spark, fa, 64)
    loci = spark.createDataFrame([("chr1", 120, 135), ("chr1", 2, 9), ("chr2", 1, 3)], "chrom string, start int, stop int")
    got = {(r.chrom, r.start): r.ref for r in text.windows(pieces, loci, 20, 64).collect()}
    assert got == {("chr1", 120): seq[100:155], ("chr1", 2): seq[:29], ("chr2", 1): "ACGT"}


def test_vcf_round_trip(spark, tmp_path):
    head = vcf_writer.header("test", [("chr1", 100)], ["a", "b"])
    variants = spark.createDataFrame([("chr1", 5, None, "AC", ["ACAC"], "START=5;DP=3"), ("chr1", 2, "x", "A", [], "START=2")], "chrom string, pos int, id string, ref string, alts array<string>, info string")
    calls = spark.createDataFrame([("chr1", 5, "a", "0|1:0|2:0.99:3"), ("chr1", 5, "b", "1/.:.:.:.")], "chrom string, pos int, sample string, cell string")
    vcf_writer.write(vcf_writer.lines(variants, calls, ["a", "b"], ["chrom", "pos"], "cell"), str(tmp_path / "v"), head)
    assert text.read_samples(spark, str(tmp_path / "v/header")) == ["a", "b"]
    back = text.read_variants(spark, str(tmp_path / "v/rows"))
    assert [(r.pos, r.alts, r.info["START"]) for r in back.orderBy("pos").collect()] == [(2, [], "2"), (5, ["ACAC"], "5")]
    got = {(r.pos, r.sample): tuple(r.gt) for r in text.calls_of(back, ["a", "b"]).collect()}
    assert got[5, "a"] == (0, 1, True, False) and got[5, "b"] == (-1, -1, False, True) and got[2, "a"][3]


def test_em_finds_the_model_it_was_fed(spark):
    rng = np.random.default_rng(3)
    true = {"in_geom": 0.9, "in_up": 0.08, "in_down": 0.12, "out_geom": 0.9, "out_up": 0.01, "out_down": 0.02}
    rows = []
    for s in range(60):
        genotype = rng.choice([0, 3, 6], 2)
        for _ in range(30):
            d, u = int(genotype[rng.integers(2)]), rng.random()
            steps = int(rng.geometric(0.9))
            d += 3 * steps if u < 0.08 else -3 * steps if u < 0.2 else 1 if u < 0.21 else -1 if u < 0.23 else 0
            rows.append((7, f"s{s}", d))
    reads = spark.createDataFrame(rows, "locus long, sample string, bp_diff int")
    regions = spark.createDataFrame([(7, 3), (8, 2)], "locus long, period int")
    got = models.learn_stutter_models(reads, regions).first()
    assert all(abs(got[c] - true[c]) < 0.05 for c in ("in_up", "in_down", "out_up", "out_down", "in_geom"))
    assert models.learn_stutter_models(reads.limit(50), regions).count() == 0


def test_stutter_function_equals_kernel(spark):
    from strandmill.plans.relational import MODEL

    df = spark.createDataFrame([(d, p) for d in range(-14, 15) for p in range(1, 7)], "d int, p int")
    from pyspark.sql import functions as F

    for r in df.select("d", "p", g.log_stutter(F.col("d"), F.col("p"), MODEL).alias("x")).collect():
        assert abs(r.x - float(k.log_stutter(np.array([r.d]), r.p, MODEL)[0])) < 1e-9


def test_alignment_micro_cases():
    assert k.align("ACGT", "TTACGTTT") == (8.0, "4=")
    assert k.align("ACCT", "TTACGTTT")[1] == "2=1X1="
    assert k.align("AAAACCCCGGGG", "AAAACCCCTTGGGG")[1] in ("8=2D4=",)
    assert k.align("AAAACCCCTTGGGG", "AAAACCCCGGGG")[1] == "8=2I4="
    assert k.align("ANT", "ACT")[0] == 6.0


def test_trio_equals_enumeration():
    rng = np.random.default_rng(5)
    n = 3
    gl = [np.log10(rng.dirichlet(np.ones(6))) for _ in range(3)]
    freq = np.log10(rng.dirichlet(np.ones(n)))
    none, new, other = k.de_novo_trio(*gl, freq)
    total, fresh = 0.0, np.zeros(n)
    for m in range(n * n):
        for f in range(n * n):
            ma, mb, fa, fb = m // n, m % n, f // n, f % n
            w = 10 ** (freq[[ma, mb, fa, fb]].sum() + gl[0][k.unordered(ma, mb)] + gl[1][k.unordered(fa, fb)])
            total += w * 10 ** gl[2][k.unordered(ma, fa)]
            for x in range(n):
                if x not in (ma, mb, fa, fb):
                    fresh[x] += w / 4 * (10 ** gl[2][k.unordered(x, fa)] + 10 ** gl[2][k.unordered(ma, x)])
    assert abs(none - math.log10(total)) < 1e-9
    assert np.allclose(new, np.log10(fresh))


def test_small_kernels():
    assert k.trim_by_quality("ACGTA", "!I5I#", "5") == (1, 1)
    assert k.end_matches("ACGTT", "acgat") == (3, 1)
    assert k.prefix_matches("aba", "ababa") == [3, 0, 3, 0, 1]
    assert k.suffix_matches("aba", "ababa") == [1, 0, 3, 0, 3]
    assert k.bases_at([("S", 1), ("M", 2), ("D", 1), ("M", 2)], "XACGT", "!abcd", 10, [9, 10, 11, 12, 13]) == [("-", "-"), ("A", "a"), ("C", "b"), ("-", "-"), ("G", "c")]
    ref = "ACGTTGCAACTGGTACCATG"
    graph = k.DeBruijn(6, ref)
    assert not graph.is_cyclic() and graph.paths() == [(ref, 1)]
    alt = ref[:9] + "G" + ref[10:]
    for _ in range(3):
        graph.add(alt)
    assert {s for s, _ in graph.paths()} == {ref, alt}
    assert k.DeBruijn(3, "ACGACGACG").is_cyclic() and k.smallest_acyclic_k(ref) == 10


@pytest.mark.parametrize("letters", ["ACGT", "A", "ACGTNacgtn", "ACG\u00e9"])
def test_pruned_graph_equals_added_edges(letters):
    rng = random.Random(3)
    for size in (1, 4, 10, 15):
        ref = "".join(rng.choices(letters, k=40))
        seqs = ["", *(ref[i : i + rng.randrange(30)] + "".join(rng.choices(letters, k=rng.randrange(4))) for i in range(20))]
        weights = [rng.randrange(1, 4) for _ in seqs]
        graph = k.DeBruijn(size, ref)
        for seq, w in zip(seqs, weights, strict=True):
            graph.add(seq, w)
        graph.prune(2)
        assert k.DeBruijn.pruned(size, ref, seqs, weights, 2).edges == graph.edges


def test_paths_follow_only_what_leads_to_the_sink():
    """Twenty bubbles of equal weight behind which no sink comes: 2 ** 20 beginnings of paths, none of them a path."""
    graph = k.DeBruijn(3, "AAAZZZ")
    graph.edges.clear()
    names = [chr(0x100 + i) for i in range(81)]
    graph.source = "".join(names[:3])
    for i in range(20):
        a = names[i * 4 : i * 4 + 7]
        graph.add("".join(a))
        graph.add("".join([*a[:3], chr(0x400 + i), *a[4:]]))
    began = time.process_time()
    assert not graph.is_cyclic() and graph.paths() == [] and time.process_time() - began < 0.5


def test_interval_join_against_brute_force(spark):
    rng = random.Random(2)
    a = [(i, "c1" if rng.random() < 0.8 else "c2", x := rng.randint(0, 900), x + rng.randint(1, 200)) for i in range(150)]
    b = [(i, "c1" if rng.random() < 0.8 else "c2", x := rng.randint(-50, 900), x + rng.randint(1, 90)) for i in range(300)]
    left, right = spark.createDataFrame(a, "i long, chrom string, s int, e int"), spark.createDataFrame(b, "j long, chrom string, p int, q int")
    for width, pad in ((16, 0), (256, 0), (64, 25)):
        got = sorted((r.i, r.j) for r in joins.overlap_join(left, right, ["chrom"], ("s", "e"), ("p", "q"), width, pad).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - pad < y[3] and y[2] < x[3] + pad)


def test_snp_overlaps_of_fixed_cases(spark):
    snps = spark.createDataFrame([("s", "c", 30), ("s", "c", 50)], "sample string, chrom string, pos int")
    spans = spark.createDataFrame([("s", "c", 35, 60), ("s", "c", 15, 32), ("s", "c", 15, 60), ("s", "c", 15, 20)], "sample string, chrom string, pos int, end_pos int")
    hits = joins.snps_in_reads(spans, snps).groupBy("pos", "end_pos").count().collect()
    assert {(r.pos, r.end_pos): r["count"] for r in hits} == {(35, 60): 1, (15, 32): 1, (15, 60): 2}
