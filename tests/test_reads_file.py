"""A BAM file of reads that get their bases once they are in order, and what it leaves in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from strandmill.plans import files
from strandmill.sources import bam
from strandmill.sources import projection as pj
from strandmill.sources.shared import shared_dir

SMALL = "/root/testdata/sf0.001"


def test_columns_made_after_ordering_give_the_same_file(spark, tmp_path):
    whole, later = str(tmp_path / "whole.bam"), str(tmp_path / "later.bam")
    bam.write_bam(files._reads(spark, SMALL), whole, files.CONTIGS, parts=3)
    bam.write_bam(files._named(pj.reads(spark, SMALL)), later, files.CONTIGS, parts=3, made=files._records_of)
    a, b = (bam.read_bam(spark, p).drop("file") for p in (whole, later))
    rows = [[(r.name, r.flag, r.chrom, r.pos, r.end_pos, r.cigar, r.bases, r.quals, r.tags) for r in t.collect()] for t in (a, b)]
    assert len(rows[0]) > 5000 and rows[0] == rows[1]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["later.bam", "later.bam.bai", "whole.bam", "whole.bam.bai"]


def test_only_the_file_is_left_and_bases_are_not_shuffled(spark):
    folder = Path(shared_dir(spark))
    before = {p.name for p in folder.iterdir()}
    assert files.src_03(spark, SMALL).where(F.col("chrom") != "chr3").count() == 0
    assert sorted(p.split(".", 1)[1] for p in {p.name for p in folder.iterdir()} - before if p.startswith(("reads", "alignments"))) == ["bam", "bam.bai"]


def test_parts_go_as_they_are_joined(spark, tmp_path, monkeypatch):
    held = []

    def index(self, store, name, made):
        held.extend(p for p in tmp_path.rglob("*") if ".parts-" in str(p) and p.is_file())

    monkeypatch.setattr(bam.BamWriter, "_index", index)
    store, path = str(tmp_path / "x.bam"), tmp_path / "x.bam.parts-1"
    path.mkdir()
    writer = bam.BamWriter({"target": store, "head": "", "join": "true", "contigs": "[]"})
    writer.run = "1"
    from strandmill.sources.blocked import Written

    for k in range(3):
        (path / f"{k}.bam").write_bytes(b"abc")
    writer.commit([Written(k, str(path / f"{k}.bam"), 3, bam.bgzf.Index([], []).to_bytes()) for k in range(3)])
    assert b"abcabcabc" in Path(store).read_bytes() and not held and not path.exists()
