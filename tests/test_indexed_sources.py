"""Blocked gzip, its indexes, and the BAM and VCF sources that read parts of files by them."""

import gzip
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandmill.sources import bam, bgzf, indexed, text, vcf_index

CONTIGS = [("chr1", 4_000_000), ("chr2", 3_000_000)]


def record(name, ref, pos, cigar, bases, flag=0):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in bases] + [0] * (len(bases) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(bases), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes([40] * len(bases)) + b"RGZg\0"
    return struct.pack("<i", len(body)) + body


def make_bam(path, n, seed, long=0):
    """A sorted BAM file of n reads, some unplaced at the end, and its index; the rows as (chrom, pos, end, name)."""
    rng = random.Random(seed)
    places = sorted((rng.randrange(2), rng.choice([rng.randrange(2_900_000), rng.randrange(50_000)])) for _ in range(n))
    sink, rows = io.BytesIO(), []
    out, index = bgzf.Writer(sink), bgzf.Index([bgzf.Contig() for _ in CONTIGS])
    head = "".join(f"@SQ\tSN:{c}\tLN:{k}\n" for c, k in CONTIGS).encode() + b"@RG\tID:g\tSM:s\tLB:l\n"
    out.write(b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(CONTIGS)))
    for c, k in CONTIGS:
        out.write(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", k))
    for k, (ref, pos) in enumerate(places):
        size = long if long and k % 50 == 7 else rng.randint(30, 150)
        low = out.tell()
        out.write(record(f"r{seed}.{k}", ref, pos, [(size, "M")], "".join(rng.choices("ACGT", k=size))))
        index.contigs[ref].add(pos, pos + size, low, out.tell())
        rows.append((CONTIGS[ref][0], pos, pos + size, f"r{seed}.{k}"))
    for k in range(5):
        out.write(record(f"u{seed}.{k}", -1, -1, [], "ACGT", 4))
        rows.append(("*", -1, -1, f"u{seed}.{k}"))
    out.flush()
    path.write_bytes(sink.getvalue() + bgzf.END)
    (path.parent / (path.name + ".bai")).write_bytes(index.to_bytes())
    return rows


def found(df):
    return sorted((r.chrom, r.pos, r.end_pos, r.name) for r in df.select("chrom", "pos", "end_pos", "name").collect())


def test_bins_hold_what_overlaps():
    rng = random.Random(1)
    for _ in range(3000):
        a, n = rng.randrange(1 << 28), int(2 ** rng.uniform(0, 27))
        b, m = max(0, a + rng.randrange(-n, n)), int(2 ** rng.uniform(0, 27))
        if b < a + n and a < b + m:
            assert bgzf.bin_of(a, a + n) in set(bgzf.bins_over(b, b + m))
    assert bgzf.bin_of(0, 1) == 4681 and bgzf.bin_of(0, 1 << 29) == 0 and bgzf.bin_of(1 << 14, (1 << 14) + 1) == 4682


def test_blocks_round_trip_and_damage(tmp_path):
    data = random.Random(2).randbytes(400_000) + b"x" * 400_000
    sink = io.BytesIO()
    out = bgzf.Writer(sink)
    marks = []
    for k in range(0, len(data), 7001):
        marks.append((out.tell(), k))
        out.write(data[k : k + 7001])
    out.flush()
    whole = sink.getvalue() + bgzf.END
    assert gzip.decompress(whole) == data
    path = tmp_path / "x.gz"
    path.write_bytes(whole)
    for at, k in marks[::9]:
        assert bgzf.Stream(bgzf.File(str(path)), at).read(5000) == data[k : k + 5000]
    starts = [at for at, _, _ in bgzf.blocks(bgzf.File(str(path)), 0)]
    for at in random.Random(3).sample(range(len(whole)), 300):
        assert bgzf.next_block(bgzf.File(str(path)), at) == next((s for s in starts if s >= at), len(whole))
    path.write_bytes(whole[:-100])
    with pytest.raises(ValueError, match="cut off"):
        bgzf.Stream(bgzf.File(str(path))).read(1 << 21)
    broken = bytearray(whole)
    broken[2000] ^= 255
    path.write_bytes(bytes(broken))
    with pytest.raises(Exception, match="damaged|invalid|Error"):
        bgzf.Stream(bgzf.File(str(path))).read(1 << 21)


def test_region_reads_only_its_blocks(spark, tmp_path):
    rows = make_bam(tmp_path / "a.bam", 20_000, 1)
    whole = (tmp_path / "a.bam").stat().st_size
    for chrom, a, b in (("chr1", 1_000_000, 1_010_000), ("chr2", 0, 10), ("chr2", 2_899_000, 2_999_000), ("chr1", 20_000, 20_001), ("chr9", 0, 100)):
        want = sorted(r for r in rows if r[0] == chrom and r[1] < b and r[2] > a)
        df = bam.read_bam(spark, str(tmp_path / "a.bam")).where((F.col("chrom") == chrom) & (F.col("pos") < b) & (F.col("end_pos") > a))
        assert found(df) == want
        assert found(bam.read_bam(spark, str(tmp_path / "a.bam"), regions=[(chrom, a, b)])) == want
        reader = bam.BamReader({"files": f'["{tmp_path}/a.bam"]', "regions": f'[["{chrom}", {a}, {b}]]'})
        taken = 0
        for part in reader.partitions():
            if part.path:
                file = bgzf.File(part.path)
                list(reader.records(part, file))
                taken += file.taken
        assert taken < 0.5 * whole


def test_several_regions_share_no_row_twice(spark, tmp_path):
    rows = make_bam(tmp_path / "a.bam", 8000, 4)
    regions = [("chr1", 0, 30_000), ("chr1", 10_000, 60_000), ("chr2", 5, 6), ("chr2", 40_000, 2_000_000)]
    want = sorted(r for r in rows if any(r[0] == c and r[1] < b and r[2] > a for c, a, b in regions))
    assert found(bam.read_bam(spark, str(tmp_path / "a.bam"), regions=regions, split=20_000)) == want


@pytest.mark.parametrize("long", [0, 300_000])
def test_files_are_cut_with_and_without_index(spark, tmp_path, long):
    rows = [r for k in range(3) for r in make_bam(tmp_path / f"{k}.bam", 2500, k, long)]
    files = [str(tmp_path / f"{k}.bam") for k in range(3)]
    df = bam.read_bam(spark, files, split=30_000 + long // 2)
    assert df.rdd.getNumPartitions() > 9 and found(df) == sorted(rows)
    for f in tmp_path.glob("*.bai"):
        f.unlink()
    for path in (files, str(tmp_path), str(tmp_path / "*.bam")):
        df = bam.read_bam(spark, path, split=30_000 + long // 2)
        assert df.rdd.getNumPartitions() > 9 and found(df) == sorted(rows)
    one = df.where((F.col("chrom") == "chr2") & (F.col("pos") < 5000))
    assert found(one) == sorted(r for r in rows if r[0] == "chr2" and r[1] < 5000)
    assert found(df.where("chrom = '*'")) == sorted(r for r in rows if r[0] == "*")


def test_merged_order_and_headers(spark, tmp_path):
    rows = [r for k in range(2) for r in make_bam(tmp_path / f"{k}.bam", 300, k)]
    files = [str(tmp_path / f"{k}.bam") for k in (1, 0)]
    df = bam.read_bam(spark, files, split=5000)
    got = [(r.chrom, r.pos) for r in bam.by_position(df, ["chr2", "chr1"]).collect()]
    assert got == sorted(((r[0], r[1]) for r in rows), key=lambda r: (["chr2", "chr1", "*"].index(r[0]), r[1]))
    own = [r.file for r in bam.by_file(df, files).collect()]
    assert own == [f for f in files for _ in range(305)]
    lines = bam.read_bam_headers(spark, files)
    contigs = text.header_contigs(lines)
    assert sorted((r.name, r.length, r.ord) for r in contigs.collect()) == sorted((c, k, i) for i, (c, k) in enumerate(CONTIGS) for _ in range(2))
    assert text.differing_contigs(contigs).count() == 0
    swapped = contigs.withColumn("ord", F.when(F.col("file") == files[0], 1 - F.col("ord")).otherwise(F.col("ord")))
    assert text.differing_contigs(swapped).count() == 2
    groups = text.header_groups(lines)
    assert {(r.sample, r.library) for r in text.with_samples(df, groups).select("sample", "library").distinct().collect()} == {("s", "l")}
    given = spark.createDataFrame([(files[0], "t", "m")], "file string, sample string, library string")
    assert {(r.file, r.sample, r.library) for r in text.with_samples(df, groups, given).select("file", "sample", "library").distinct().collect()} == {(files[0], "t", "m"), (files[1], "s", "l")}
    with pytest.raises(Exception, match="without a sample"):
        text.with_samples(df, groups.limit(0)).collect()


@pytest.mark.parametrize("join", [True, False])
def test_bam_round_trip(spark, tmp_path, join):
    rows = make_bam(tmp_path / "a.bam", 1500, 9)
    df = bam.read_bam(spark, str(tmp_path / "a.bam"))
    path = str(tmp_path / ("b.bam" if join else "b"))
    tagged = df.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("FT"), F.lit("HARD_CLIPPED"), F.lit("HP"), F.lit("-7"))))
    bam.write_bam(tagged.repartition(5), path, CONTIGS, ["@HD\tVN:1.6", "@RG\tID:g\tSM:s"], join, 3)
    back = bam.read_bam(spark, path, split=20_000)
    columns = [c for c in df.columns if c not in ("file", "tags")]
    assert back.select(columns).exceptAll(df.select(columns)).count() == 0 and back.count() == len(rows)
    assert {tuple(sorted(r.tags.items())) for r in back.select("tags").collect()} == {(("FT", "HARD_CLIPPED"), ("HP", "-7"), ("RG", "g"))}
    files = indexed.listed([path], ".bam")
    assert (len(files) == 1) == join and len(list(tmp_path.glob("**/*.parts-*"))) == 0
    want = sorted(r for r in rows if r[0] == "chr1" and r[1] < 30_000 and r[2] > 20_000)
    assert found(bam.read_bam(spark, path, [("chr1", 20_000, 30_000)])) == want
    if join:
        own = [(r.chrom, r.pos) for r in bam.read_bam(spark, path, split=1 << 30).collect()]
        assert own == sorted(((r[0], r[1]) for r in rows), key=lambda r: (["chr1", "chr2", "*"].index(r[0]), r[1]))
    with pytest.raises(Exception, match="no contig chr2"):
        bam.write_bam(df, str(tmp_path / "c.bam"), CONTIGS[:1])


HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta"]


def vcf_rows(n, seed=5):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        chrom, pos = rng.choice(["chr10", "chr2", "chr1"]), rng.choice([rng.randrange(1, 40_000), rng.randrange(1, 5_000_000)])
        ref, info = "A" * rng.randint(1, 60), rng.choice([".", f"END={pos + rng.randint(0, 90_000)};START={pos}", "X=" + rng.randbytes(rng.randint(0, 1500)).hex()])
        out.append((chrom, pos, f"{chrom}\t{pos}\tv{k}\t{ref}\tC\t.\t.\t{info}\tGT\t0|1"))
    return out


def overlap(rows, chrom, a, b):
    return sorted(v for c, _, v in rows if c == chrom and vcf_index.place_of(v.encode())[1] - 1 < b and vcf_index.place_of(v.encode())[2] > a)


@pytest.mark.parametrize("join", [True, False])
def test_vcf_is_written_sorted_and_read_by_region(spark, tmp_path, join):
    rows = vcf_rows(4000)
    path = str(tmp_path / ("v.vcf.gz" if join else "v"))
    df = spark.createDataFrame(rows, "chrom string, pos long, value string").repartition(7)
    vcf_index.write_vcf(df, path, HEAD, ["chr1", "chr2", "chr10"], join, 4)
    assert not list(tmp_path.glob("*.parts-*"))
    files = indexed.listed([path], ".vcf.gz")
    assert (len(files) == 1) == join and vcf_index.header_of(path) == HEAD
    lines = [x for f in files for x in gzip.decompress(open(f, "rb").read()).decode().splitlines() if not x.startswith("#")]
    order = {c: k for k, c in enumerate(["chr1", "chr2", "chr10"])}
    assert lines == [v for _, _, _, v in sorted((order[c], p, v, v) for c, p, v in rows)]
    got = vcf_index.read_vcf_lines(spark, path, split=30_000)
    assert sorted(r.value for r in got.collect()) == sorted(lines)
    for chrom, a, b in (("chr2", 10_000, 10_500), ("chr10", 0, 1), ("chr1", 1_000_000, 3_000_000), ("chrX", 0, 9)):
        assert sorted(r.value for r in vcf_index.read_vcf_lines(spark, path, [(chrom, a, b)], split=30_000).collect()) == overlap(rows, chrom, a, b)
        near = got.where((F.col("chrom") == chrom) & (F.col("pos") <= b) & (F.col("end_pos") > a))
        assert sorted(r.value for r in near.collect()) == overlap(rows, chrom, a, b)
    taken = 0
    reader = vcf_index.VcfReader({"files": f'["{path}"]', "regions": '[["chr2", 2000000, 2000100]]'})
    for part in reader.partitions():
        if part.path:
            file = bgzf.File(part.path)
            list(reader.rows(part, file))
            taken += file.taken
    assert 0 < taken < 0.5 * sum((tmp_path / f).stat().st_size for f in files)
    assert {(r.chrom, r.pos) for r in vcf_index.read_vcf(spark, path, [("chr2", 0, 20_000)]).collect()} >= {(c, p) for c, p, _ in rows if c == "chr2" and p <= 20_000}


def test_vcf_without_index_and_with_an_old_one(spark, tmp_path):
    import os

    rows = vcf_rows(3000)
    path = str(tmp_path / "v.vcf.gz")
    vcf_index.write_vcf(spark.createDataFrame(rows, "chrom string, pos long, value string"), path, HEAD)
    os.utime(path + ".tbi", (1, 1))
    with pytest.raises(Exception, match="older"):
        vcf_index.read_vcf_lines(spark, path).collect()
    os.remove(path + ".tbi")
    df = vcf_index.read_vcf_lines(spark, path, split=20_000)
    assert df.rdd.getNumPartitions() > 5 and sorted(r.value for r in df.collect()) == sorted(v for _, _, v in rows)
    vcf_index.write_vcf(df.select("chrom", "pos", "value").limit(0), str(tmp_path / "none.vcf.gz"), HEAD)
    assert vcf_index.read_vcf_lines(spark, str(tmp_path / "none.vcf.gz")).count() == 0 and vcf_index.header_of(str(tmp_path / "none.vcf.gz")) == HEAD
