"""Alignment columns against a plain overlay."""

import random
import re

from pyspark.sql import functions as F

from strandmill.operators import columns


def plain(reads):
    """{rid: row} of the reads (rid, pos, cigar, bases) of one locus."""
    cells, size = {}, {}
    for rid, pos, cigar, bases in reads:
        own, added, at, seen = {}, {}, pos, 0
        for n, op in re.findall(r"(\d+)(\D)", cigar):
            n = int(n)
            if op == "M":
                own.update({at + k: bases[seen + k] for k in range(n)})
            if op == "D":
                own.update({at + k: "-" for k in range(n)})
            if op == "I":
                added[at] = bases[seen : seen + n]
                size[at] = max(size.get(at, 0), n)
            at += n if op in "MD" else 0
            seen += n if op in "MIS" else 0
        cells[rid] = (pos, at, own, added)
    first, last = min(c[0] for c in cells.values()), max(c[1] for c in cells.values())
    out = {}
    for rid, (pos, end, own, added) in cells.items():
        row = ""
        for p in range(first, last + 1):
            n = size.get(p, 0)
            row += added[p].ljust(n, "-") if p in added else ("-" if pos < p < end else " ") * n
            row += own.get(p, " ") if p < last else ""
        out[rid] = row
    return out, first, last, size


def test_rows_equal_a_plain_overlay(spark):
    rng = random.Random(6)
    reads = []
    for locus in range(25):
        for k in range(rng.randint(1, 12)):
            ops = [(rng.randint(1, 9), "M")]
            for _ in range(rng.randint(0, 3)):
                ops += [(rng.randint(1, 4), rng.choice("ID")), (rng.randint(1, 9), "M")]
            if rng.random() < 0.2:
                ops.append((2, "I"))
            if rng.random() < 0.3:
                ops = [(3, "S"), *ops, (1, "S")]
            size = sum(n for n, op in ops if op in "MIS")
            pos = rng.randint(0, 12)
            reads.append((f"{locus}.{k}", locus, pos, pos + sum(n for n, op in ops if op in "MD"), "".join(f"{n}{op}" for n, op in ops), "".join(rng.choices("ACGT", k=size))))
    df = spark.createDataFrame([*reads, ("none", 1, 0, 0, "", "AC")], "rid string, locus long, pos long, end_pos long, cigar string, bases string")
    got = {r.rid: r for r in columns.overlaid(df).withColumn("ref", columns.reference_row(F.lit("ACGT" * 30), F.lit(0), F.col("first"), F.col("last"), F.col("gaps"))).withColumn("html", columns.html_row(F.col("row"), F.col("ref"))).collect()}
    assert len(got) == len(reads)
    for locus in range(25):
        own = [(r[0], r[2], r[4], r[5]) for r in reads if r[1] == locus]
        want, first, last, size = plain(own)
        ref = "".join("-" * size.get(p, 0) + ("ACGT" * 30)[p] for p in range(first, last)) + "-" * size.get(last, 0)
        for rid, row in want.items():
            r = got[rid]
            assert (r.first, r.last, r.gaps) == (first, last, size) and r.row == row and r.ref == ref and len(r.row) == len(ref)
            assert r.html.count("<td>") == len(ref) and re.sub("<[^>]*>", "", r.html) == row.replace(" ", "")
        assert all(any(row[k] not in " -" for row in want.values()) or ref[k] != "-" for k in range(len(ref)))
