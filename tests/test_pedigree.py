"""Generations, lineages and nuclear families against plain walks over random pedigrees."""

import random

import pytest

from strandmill.operators import pedigree as pg

SCHEMA = "family long, child string, father string, mother string"


def made(seed, families=60):
    rng, rows = random.Random(seed), []
    for f in range(families):
        people = [f"{f}.{k}" for k in range(rng.randint(1, 3))]
        for k in range(len(people), len(people) + rng.choice([1, 2, 2, 3, 8])):
            pair = rng.sample(people, 2) if len(people) > 1 and rng.random() < 0.8 else [rng.choice(people), None]
            if rng.random() < 0.4 and len(rows) and rows[-1][0] == f:
                pair = list(rows[-1][2:])
            rng.shuffle(pair)
            rows.append((f, f"{f}.{k}", *pair))
            people.append(f"{f}.{k}")
    everyone = sorted({p for r in rows for p in r[1:] if p})
    return rows, {p for p in everyone if rng.random() < 0.75}


def plain(rows, sequenced):
    """Layers, kept people and nuclear families (by walking connected parts)."""
    parents = {c: [p for p in (a, b) if p] for _, c, a, b in rows}
    everyone = {p for r in rows for p in r[1:] if p}

    def layer(p):
        return 1 + max(layer(q) for q in parents[p]) if parents.get(p) else 0

    def ancestors(p):
        return {p}.union(*(ancestors(q) for q in parents.get(p, [])))

    above = {p: ancestors(p) for p in everyone}
    kept = {p for p in everyone if above[p] & sequenced and any(p in above[q] for q in sequenced & everyone)}
    own = {c: [p for p in parents.get(c, []) if p in kept] for c in kept}
    children = {p: [c for c in kept if p in own[c]] for p in kept}
    seen, families = set(), []
    for start in kept:
        if start in seen:
            continue
        part, queue = set(), [start]
        while queue:
            p = queue.pop()
            if p not in part:
                part.add(p)
                queue += own[p] + children[p]
        seen |= part
        tops, ends = [p for p in part if not own[p]], [p for p in part if not children[p]]
        if len(tops) == 2 and ends and len(tops) + len(ends) == len(part) and all(set(own[c]) == set(tops) for c in ends):
            first = min(ends)
            family, _, father, mother = next(r for r in rows if r[1] == first)
            families.append((family, mother, father, tuple(sorted(ends))))
    lineage = sorted((f, c, a if a in kept else None, b if b in kept else None) for f, c, a, b in rows if c in kept)
    return {p: layer(p) for p in everyone}, kept, lineage, sorted(families)


def test_equals_plain_walks(spark):
    rows, sequenced = made(4)
    df = spark.createDataFrame(rows + rows[:3] + [(1, None, None, None)], SCHEMA).repartition(3)
    who = spark.createDataFrame([(p,) for p in sequenced] + [("stranger",)], "person string")
    layers, kept, lineage, families = plain(rows, sequenced)
    own = pg.checked(df)
    ordered = pg.in_order(df).collect()
    assert {r.person: r.layer for r in ordered} == layers
    place = {r.person: r.ord for r in ordered}
    assert sorted(place.values()) == list(range(1, len(layers) + 1)) and all(place[p] < place[c] for _, c, a, b in rows for p in (a, b) if p)
    got, people = pg.sequenced_lineage(own, who)
    assert {r.person for r in people.collect()} == kept
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lineage, key=str)
    found = sorted((r.family, r.mother, r.father, tuple(r.children)) for r in pg.nuclear_families(own, who).collect())
    assert found == families and len(families) > 3


def test_errors_and_no_rows(spark):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="ancestors"):
        pg.generations(table([(1, "a", "b", None), (1, "b", "a", None), (1, "c", None, None)]))
    with pytest.raises(ValueError, match="two families"):
        pg.checked(table([(1, "a", None, None), (2, "b", "a", None)]))
    with pytest.raises(ValueError, match="two pairs"):
        pg.checked(table([(1, "a", "x", None), (1, "a", "y", None)]))
    assert pg.generations(table([])).count() == 0
    assert pg.nuclear_families(table([]), spark.createDataFrame([], "person string")).count() == 0
