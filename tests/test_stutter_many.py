import numpy as np

from strandmill.functions import kernels as k


def test_loci_learned_together_have_the_models_of_each_alone():
    draw = np.random.default_rng(3)
    for n in (1, 4, 9):
        alleles, counts, present, period, want = [], [], [], [], []
        for locus in range(12):
            own = np.append(0, np.sort(draw.choice([x for x in range(-90, 91) if x] if locus > 9 else [x for x in range(-8, 9) if x], n - 1, replace=False)))
            people = int(draw.integers(1, 5))
            table = np.zeros((5, n))
            table[:people] = draw.integers(0, 6, (people, n))
            table[:people, draw.integers(0, n)] += 9
            who, what = np.nonzero(table)
            alleles.append(own), counts.append(table), present.append(np.arange(5) < people), period.append(int(draw.integers(1, 7)))
            want.append(k.learn_stutter(own[what], who, period[-1], n=table[who, what]) if len(set(own[what].tolist()) | {0}) == n else "other")
        got = k.learn_stutter_many(np.array(alleles), np.array(counts), np.array(present), np.array(period))
        for a, b in zip(got, want, strict=True):
            assert b == "other" or (a is None) == (b is None)
            assert b in (None, "other") or all(abs(a[c] - b[c]) < 1e-9 for c in b)
