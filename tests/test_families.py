"""Haplotype words, inheritance and the family scan against plain loops."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from strandmill.operators import families as fm


def made(seed=2, sites=900):
    """Two families over two chromosomes; children inherit with a switch, some errors and missing genotypes."""
    rng = random.Random(seed)
    kin = [(1, "c1", "m1", "f1"), (1, "c2", "m1", "f1"), (2, "c3", "m2", "f2")]
    calls = []
    for chrom in ("chr1", "chr2"):
        for pos in sorted(rng.sample(range(100_000), sites)):
            own = {p: [rng.randrange(2), rng.randrange(2)] for p in ("m1", "f1", "m2", "f2")}
            own["c1"] = [own["m1"][pos > 50_000], own["f1"][0]]
            own["c2"] = [own["f1"][1], own["m1"][0]]
            own["c3"] = [own["m2"][1], own["f2"][1]] if chrom == "chr1" else [rng.randrange(2), rng.randrange(2)]
            for p, g in own.items():
                if rng.random() < 0.004:
                    g[0] = 1 - g[0]
                calls.append((chrom, pos, p, *(g if rng.random() > 0.01 else (None, None))))
    return kin, calls


def plain(kin, calls, chrom, pos, reach):
    """{child: (maternal distances, paternal distances)} site by site."""
    by_site = {}
    for c, at, p, a, b in calls:
        if c == chrom and abs(at - pos) <= reach:
            by_site.setdefault(at, {})[p] = (a, b)
    out = {c: [[0] * 4, [0] * 4] for _, c, _, _ in kin}
    for family in {k[0] for k in kin}:
        rows = [k for k in kin if k[0] == family]
        for g in by_site.values():
            people = {x for r in rows for x in r[1:]}
            if any(g[p][0] is None for p in people):
                continue
            if not all((g[c][0] in g[m] and g[c][1] in g[f]) or (g[c][1] in g[m] and g[c][0] in g[f]) for _, c, m, f in rows):
                continue
            for _, c, m, f in rows:
                for k, (x, y) in enumerate(itertools.product(range(2), repeat=2)):
                    out[c][0][k] += g[c][x] != g[m][y]
                    out[c][1][k] += g[c][x] != g[f][y]
    return out


def chosen(mother, father, most, following):
    best = []
    for d in (mother, father):
        k = min(range(4), key=lambda x: d[x])
        if d[k] > most or sorted(d)[1] < following:
            return None, None
        best.append(k)
    return tuple(best) if (best[0] < 2) != (best[1] < 2) else (None, None)


def test_distances_and_inheritance(spark):
    kin, calls = made()
    table = spark.createDataFrame(calls, "chrom string, pos long, person string, gt_a int, gt_b int").repartition(4)
    rng = random.Random(3)
    loci = [(k, rng.choice(["chr1", "chr2"]), rng.randrange(100_000)) for k in range(40)] + [(40, "chr1", 10**7), (41, "chr9", 5)]
    near = spark.createDataFrame(loci, "locus long, chrom string, pos long")
    members = spark.createDataFrame(kin, "family int, child string, mother string, father string")
    sites = fm.numbered_sites(table)
    words = fm.haplotype_words(table, sites)
    for reach in (20_000, 500_000):
        found = fm.distances(near, fm.family_words(words, members), sites, reach)
        got = {(r.locus, r.child): ([r[f"m{k}"] for k in range(4)], [r[f"f{k}"] for k in range(4)]) for r in found.collect()}
        inherited = {(r.locus, r.child): (r.maternal, r.paternal) for r in fm.inheritance(found, 10, 40).collect()}
        matched = set()
        for locus, chrom, pos in loci:
            want = plain(kin, calls, chrom, pos, reach)
            for child, (m, f) in want.items():
                if chrom == "chr9":
                    assert (locus, child) not in got
                    continue
                assert got[locus, child] == (m, f)
                assert inherited[locus, child] == chosen(m, f, 10, 40)
                matched.add(inherited[locus, child])
        assert len(matched) > 2 or reach > 20_000


def plain_scan(mother, father, children, maternal, paternal, freq):
    n = len(freq)
    none, new, other = 0.0, [0.0] * len(children), [0.0] * len(children)
    for i, j, k, l in itertools.product(range(n), repeat=4):  # noqa: E741
        parents = 10 ** (mother[i][j] + freq[i] + freq[j] + father[k][l] + freq[k] + freq[l])
        pairs = []
        for a, b in zip(maternal, paternal, strict=True):
            pair = [None, None]
            pair[a // 2] = (i, j)[a % 2]
            pair[b // 2] = (k, l)[b % 2]
            pairs.append(pair)
        each = [10 ** c[x][y] for c, (x, y) in zip(children, pairs, strict=True)]
        none += parents * math.prod(each)
        for c, (x, y) in enumerate(pairs):
            rest = parents * math.prod(e for z, e in enumerate(each) if z != c)
            for to in range(n):
                for pair in ([(to, y)] if to != x else []) + ([(x, to)] if to != y else []):
                    value = rest * 10 ** children[c][pair[0]][pair[1]] / (2 * (n - 1))
                    (other if to in (i, j, k, l) else new)[c] += value
    log = lambda v: math.log10(v) if v else -math.inf
    return log(none), [log(v) for v in new], [log(v) for v in other]


def test_scan(spark):
    rng = np.random.default_rng(4)
    kin = [(1, "c1", "m1", "f1"), (1, "c2", "m1", "f1"), (2, "c3", "m2", "f2")]
    pairs = [(0, 2), (0, 3), (1, 2), (2, 0), (3, 1), (2, 1)]
    inherited, likelihoods, gls = [], [], {}
    for locus in range(30):
        n = 1 if locus == 7 else int(rng.integers(2, 5))
        freq = np.log10(rng.dirichlet(np.ones(n)))
        for p in ("c1", "c2", "c3", "m1", "f1", "m2", "f2"):
            gls[locus, p] = (-3 * rng.random((n, n))), freq
            if (locus, p) != (5, "f1"):
                likelihoods.append((locus, p, gls[locus, p][0].ravel().tolist(), freq.tolist()))
        for family, child, _, _ in kin:
            pair = pairs[rng.integers(len(pairs))] if (locus, child) != (9, "c2") else (None, None)
            inherited.append((locus, family, child, *(x if x is None else int(x) for x in pair)))
    got = fm.scan(
        spark.createDataFrame(kin, "family int, child string, mother string, father string"),
        spark.createDataFrame(inherited, "locus long, family int, child string, maternal int, paternal int"),
        spark.createDataFrame(likelihoods, "locus long, person string, gl array<double>, log_freq array<double>"),
    )
    found = {(r.locus, r.family): r for r in got.withColumn("call", fm.family_call()).collect()}
    assert (7, 1) not in found and (5, 1) not in found and (5, 2) in found and (9, 1) not in found and len(found) == 60 - 4
    at = {(locus, c): (a, b) for locus, _, c, a, b in inherited}
    for (locus, family), r in found.items():
        rows = [k for k in kin if k[0] == family]
        names = sorted(k[1] for k in rows)
        none, new, other = plain_scan(gls[locus, rows[0][2]][0], gls[locus, rows[0][3]][0], [gls[locus, c][0] for c in names], *zip(*(at[locus, c] for c in names), strict=True), gls[locus, names[0]][1])
        assert r.children == names and math.isclose(r.no_mutation, none, abs_tol=1e-9)
        assert np.allclose(r.de_novo, new) and np.allclose(r.other, other)
        total = math.log10(sum(10**x for x in new + other))
        assert math.isclose(r.any_mutation, total, abs_tol=1e-9)
        assert r.call == ":".join([",".join(names), f"{none:.3f}", f"{total:.3f}", ",".join(f"{x:.3f}" for x in new), ",".join(f"{x:.3f}" for x in other)])
    missing = spark.range(1).select(F.lit(None).cast("double").alias("no_mutation"), F.lit(None).cast("double").alias("any_mutation"), *(F.lit(None).cast("array<double>").alias(c) for c in ("de_novo", "other")), F.lit(None).cast("array<string>").alias("children"))
    assert missing.select(fm.family_call().alias("x")).first().x == "."
