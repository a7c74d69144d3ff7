import random

from strandmill.functions import kernels as k


def test_diagonals_agree_with_the_full_alignment_and_settle_one_deletion():
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    pairs = []
    for trial in range(600):
        ref = word(draw.randint(20, 90)) if trial % 3 else draw.choice(("A", "AC", "AAC")) * 20
        n = draw.randint(1, len(ref))
        at, cut, gap = draw.randint(0, len(ref) - n), draw.randint(0, n), draw.randint(0, 6)
        read = ref[at : at + cut] + ref[at + cut + gap : at + n]
        for _ in range(draw.choice((0, 0, 1, 2))):
            i = draw.randint(0, len(read))
            read = read[:i] + word(1) + read[i + draw.randint(0, 1) :]
        pairs.append((read or "A", ref if trial % 50 else ref[:-1] + "N"))
    found = k.align_on_diagonals(*zip(*pairs))
    assert all(x is None or x == k.align(*p) for x, p in zip(found, pairs, strict=True))
    assert sum(x is not None for x in found) > 300
    assert k.align_on_diagonals(["ACGTACGGTACCATTG"], ["TTACGTACGCCCGTACCATTGA"])[0] == k.align("ACGTACGGTACCATTG", "TTACGTACGCCCGTACCATTGA")
