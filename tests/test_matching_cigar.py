import random
import time

from strandmill.functions import haplotypes as hp


def test_a_long_read_with_many_mismatches_is_walked_in_time_with_its_length():
    draw = random.Random(2)
    bases = "".join(draw.choices("ACGT", k=30_000))
    ref = "".join(draw.choices("ACGT", k=30_000))
    began = time.perf_counter()
    kept, ops = hp.matching_cigar([("S", 5), ("M", 20_000), ("D", 3), ("I", 2), ("M", 9_000)], bases, 7, ref, 7)
    assert time.perf_counter() - began < 1
    assert kept == bases[5:29_007]
    text = "".join(op * n for op, n in ops)
    want = ["=" if bases[5 + i] == ref[i] else "X" for i in range(20_000)] + ["=" if bases[20_007 + i] == ref[20_003 + i] else "X" for i in range(9_000)]
    assert text == "".join(want[:20_000]) + "DDDII" + "".join(want[20_000:])
    assert all(a[0] != b[0] for a, b in zip(ops, ops[1:]))
