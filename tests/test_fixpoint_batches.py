"""Scores and genotypes by batch: edit distances of many pairs, groups that go on over batches, bases cut out of reads."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandmill.functions import cigars as cg
from strandmill.functions import edits
from strandmill.operators import fixpoint

from test_fixpoint import edits as plain

MODEL = {"in_geom": 0.9, "in_up": 0.05, "in_down": 0.08, "out_geom": 0.9, "out_up": 0.01, "out_down": 0.01}


def test_distances_equal_the_plain_table():
    rng = random.Random(1)
    seqs = ["".join(rng.choices("ACGTNé𝒳", k=n)) for n in (0, 1, 3, 20, 60, 63, 64, 65, 70, 127, 128, 129, 200) for _ in range(3)]
    others = [s[: rng.randint(0, len(s))] + rng.choice("ACGTZ") + s[rng.randint(0, len(s)) :] for s in seqs] + ["", "A" * 150]
    which, other = (np.array(x) for x in zip(*((i, j) for i in range(len(seqs)) for j in [i, *rng.sample(range(len(others)), 8)]), strict=True))
    assert edits.distances(seqs, others, which, other).tolist() == [plain(seqs[i], others[j]) for i, j in zip(which, other, strict=True)]
    assert edits.distances([], [], [], []).tolist() == []


def test_scores_of_a_batch_equal_those_of_columns(spark):
    rng = random.Random(2)
    rows = [(1 + n % 4, n, "".join(rng.choices("ACGT", k=rng.randint(1, 80)))) for n in range(60)]
    seqs = spark.createDataFrame([(i, s) for i, _, s in rows], "locus long, seq string")
    new = spark.createDataFrame([(i, n // 4, s) for i, n, s in rows if n < 24], "locus long, allele long, aseq string")
    periods, score = spark.createDataFrame([(i, i) for i in range(1, 5)], "locus long, period int"), fixpoint.stutter_score(MODEL)
    many, columns = ({(r.locus, r.seq): [tuple(x) for x in r.s] for r in fixpoint._scored(seqs, new, periods, by).collect()} for by in (score, lambda *c: score(*c)))
    assert len(many) == 60 and many.keys() == columns.keys()
    for key, want in columns.items():
        assert [x[:2] for x in many[key]] == [x[:2] for x in want] and np.allclose([x[2] for x in many[key]], [x[2] for x in want], atol=1e-9)


def test_groups_go_on_over_batches(monkeypatch):
    rng = random.Random(3)
    kind = pa.schema([("locus", pa.int64()), ("sample", pa.string()), ("seq", pa.string()), ("n", pa.int64()), ("s", fixpoint._ARROW_SCORES)])
    rows = []
    for group in range(12):
        alleles = [3, 5, 8][: 1 + group % 3]
        for i in range(rng.choice([1, 2, 40])):
            scores = [{"allele": a, "size": a, "lp": -rng.random() * 9} for a in alleles]
            rows.append({"locus": group // 2, "sample": None if group % 2 == 0 and group > 8 else f"s{group % 2}", "seq": "A" * rng.choice([3, 5, 7]), "n": rng.randint(1, 5), "s": scores})
    whole = pa.RecordBatch.from_pylist(rows, kind)
    want = pa.Table.from_batches(fixpoint._genotypes_of(iter([whole]))).to_pylist()
    assert len(want) == len(rows) and sum(r["leads"] for r in want) == 12
    for size, cells in ((1, 1 << 18), (7, 6), (len(rows), 1)):
        monkeypatch.setattr(fixpoint, "CELLS", cells)
        parts = [whole.slice(k, size) for k in range(0, len(rows), size)]
        got = pa.Table.from_batches(fixpoint._genotypes_of(iter([whole.slice(0, 0), *parts]))).to_pylist()
        for a, b in zip(got, want, strict=True):
            assert (a.pop("log_post") is None) == ((post := b["log_post"]) is None) and a == {c: x for c, x in b.items() if c != "log_post"}, post


def test_bases_between_equal_those_of_columns(spark):
    rng = random.Random(4)
    rows = []
    for n in range(300):
        ops = [(rng.choice("M=XIDN"), rng.randint(1, 6)) for _ in range(rng.randint(1, 6))]
        ops = ([("H", 2)] if rng.random() < 0.2 else []) + ([("S", 3)] if rng.random() < 0.3 else []) + ops
        pos, start = rng.randint(0, 10), rng.randint(0, 20)
        rows.append((n, "".join(f"{m}{op}" for op, m in ops), "".join(rng.choices("ACGT", k=sum(m for op, m in ops if op in "M=XIS"))), pos, pos + sum(m for op, m in ops if op in "M=XDN"), start, start + rng.randint(0, 12)))
    rows.append((300, None, "ACGT", 0, 9, 1, 3))
    df = spark.createDataFrame(rows, "n long, cigar string, bases string, pos long, end_pos long, start long, stop long")
    c = F.col
    walked = cg.sequence_between(cg.steps(c("cigar"), c("pos")), c("bases"), c("pos"), c("end_pos"), c("start"), c("stop"))
    got = df.select(cg.bases_between(c("cigar"), c("bases"), c("pos"), c("end_pos"), c("start"), c("stop")).alias("a"), walked.alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(bool(r.a) for r in got) > 20
