import pytest

from strandmill.functions import read_ops as r


def read(cigar, bases=None, pos=100):
    n = sum(k for op, k in cigar if op in r.ON_READ)
    bases = bases or ("ACGT" * n)[:n]
    return r.Read(pos, tuple(cigar), bases, "I" * n)


def test_length_change():
    x = read([("M", 20), ("I", 3), ("M", 10), ("D", 2), ("M", 20)])
    assert r.length_change(x, 115, 135) == 1
    assert r.length_change(x, 115, 125) == 3
    assert r.length_change(x, 99, 120) is None and r.length_change(x, 110, 160) is None
    assert r.length_change(x, 102, 110) == 0


def test_distances_and_trims():
    x = read([("S", 2), ("M", 10), ("I", 2), ("M", 6), ("D", 3), ("M", 5)])
    assert r.distance_to_indel(x.cigar) == (10, 5)
    assert r.distance_to_indel([("M", 9)]) == (-1, -1)
    assert r.trim(x, 2, 0).pos == 100 and r.trim(x, 2, 0).cigar[0] == ("M", 10)
    y = r.trim(x, 0, 5)
    assert y.cigar[-1] == ("M", 6) and y.end == 116 and y.bases == x.bases[:-5]
    assert r.trim(x, 12, 0).cigar == (("I", 2), ("M", 6), ("D", 3), ("M", 5)) and r.trim(x, 12, 0).pos == 110
    assert r.trim(x, 20, 20).cigar == ()
    z = r.trim_to(read([("M", 50)]), 110, 129)
    assert (z.pos, z.end, len(z.bases)) == (110, 130, 20)


def test_adapters():
    seq = "GATTACAGATTACAGA"
    x = read([("M", 26)], seq + r.ADAPTERS[1][0][:10])
    assert r.trim_adapter(x, 1, False).bases == seq
    back = read([("M", 26)], r.complement(seq + r.ADAPTERS[2][0][:10]))
    assert r.trim_adapter(back, 2, True).bases == r.complement(seq) and r.trim_adapter(back, 2, True).pos == 110
    assert r.trim_adapter(read([("M", 16)], seq), 1, False).bases == seq


def test_ends_and_sequences():
    ref = "TTTTACGTACGGATCCATTT"
    x = read([("M", 12)], "ACGTACGGATCC", 104)
    assert r.matches_at_ends(x, ref, 100) == (12, 12) and r.largest_end_matches(x, ref, 100)
    bad = read([("M", 12)], "ACGTACGGATCA", 104)
    assert r.matches_at_ends(bad, ref, 100) == (11, 0)
    shifted = read([("M", 8)], "ACGGATCC", 107)
    assert not r.largest_end_matches(shifted, ref, 100)
    y = read([("S", 2), ("M", 4), ("I", 2), ("M", 4)], "NNACGTTTACGG", 104)
    assert r.unclipped(y) == (104, 112, "ACGTTTACGG")
    assert r.sequence_between(y, 106, 108) == "GTTT" and r.sequence_between(y, 108, 112) == "ACGG" and r.sequence_between(y, 100, 106) is None
