"""Pedigrees by joins: generations by peeling, lineages of sequenced people, nuclear families.

People may be many and families large: every step is a join over all families at once, each round is written to the
shared folder, and there are as many rounds as generations. Nothing of a family is gathered but its children's names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, written


def edges(rows: DataFrame) -> DataFrame:
    """(child, parent) of rows (family, child, father, mother)."""
    return rows.select("child", F.explode(F.array("father", "mother")).alias("parent")).where("parent is not null").distinct()


def people(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("child", "father", "mother")).alias("person")).where("person is not null").distinct()


def checked(rows: DataFrame) -> DataFrame:
    """The distinct rows; a person named under two families, or a child with two pairs of parents, is an error."""
    rows = rows.select("family", "child", "father", "mother").where(F.col("child").isNotNull()).distinct()
    named = rows.select("family", F.explode(F.array("child", "father", "mother")).alias("person")).where("person is not null")
    two = named.groupBy("person").agg(F.countDistinct("family").alias("n")).where("n > 1").limit(3).collect()
    if two:
        raise ValueError(f"in two families: {', '.join(str(r.person) for r in two)}")
    twice = rows.groupBy("child").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"with two pairs of parents: {', '.join(str(r.child) for r in twice)}")
    return rows


def generations(rows: DataFrame) -> DataFrame:
    """(person, layer): 0 for people without parents, else one more than the later of the parents.

    Parents that are in place go from the edges of their children, whoever has none left is next. People who are never
    next are their own ancestors, or have one who is: an error.
    """
    left = written(edges(rows), "edges")
    everyone = written(people(rows), "people")
    now = everyone.join(left.select(F.col("child").alias("person")), "person", "left_anti")
    layers, layer, tables = [], 0, [everyone, left]
    while True:
        now = written(now.select("person", F.lit(layer).alias("layer")), "layer")
        if now.isEmpty():
            break
        layers.append(now)
        waiting = left.select("child").distinct()
        left = written(left.join(now.select(F.col("person").alias("parent")), "parent", "left_anti"), "edges")
        tables.append(left)
        now = waiting.join(left, "child", "left_anti").select(F.col("child").alias("person"))
        layer += 1
    stuck = left.select("child").limit(3).collect()
    if stuck:
        raise ValueError(f"their own ancestors, or descendants of such: {', '.join(str(r.child) for r in stuck)}")
    out = everyone.select("person", F.lit(0).alias("layer")).limit(0) if not layers else layers[0]
    for own in layers[1:]:
        out = out.unionByName(own)
    out = written(out, "generations")
    discard(*tables, *layers)
    return out


def _reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """All people that links (a, b) lead to from `start`, itself included; a round for each generation."""
    known = written(start.select("person").distinct(), "reached")
    new = known
    while not new.isEmpty():
        beyond = links.join(new.select(F.col("person").alias("a")), "a").select(F.col("b").alias("person")).distinct()
        new = written(beyond.join(known, "person", "left_anti"), "reached")
        known = written(known.unionByName(new), "reached")
    return known


def sequenced_lineage(rows: DataFrame, sequenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of people who are sequenced, or have sequenced people both above and below them, with parents that are
    not kept as nulls, and the people kept (person)."""
    links = edges(rows)
    start = people(rows).join(sequenced.select("person").distinct(), "person", "left_semi")
    below = _reached(links.select(F.col("parent").alias("a"), F.col("child").alias("b")), start)
    above = _reached(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), start)
    kept = written(below.join(above, "person", "left_semi"), "kept")
    out = rows.join(kept.select(F.col("person").alias("child")), "child", "left_semi")
    for who in ("father", "mother"):
        own = kept.select(F.col("person").alias(who), F.lit(True).alias(f"{who}_kept"))
        out = out.join(own, who, "left").withColumn(who, F.when(F.col(f"{who}_kept"), F.col(who))).drop(f"{who}_kept")
    return out.select("family", "child", "father", "mother"), kept


def nuclear_families(rows: DataFrame, sequenced: DataFrame) -> DataFrame:
    """(family, mother, father, children): of the lineage, parts of two founders and their common children alone.

    A couple and their children stand alone if neither has parents or other children, and no child has any. Roles are
    those of the first child.
    """
    lineage, _ = sequenced_lineage(rows, sequenced)
    lineage = written(lineage, "lineage")
    links = edges(lineage)
    has_parents = links.select(F.col("child").alias("person")).distinct()
    brood = links.groupBy(F.col("parent").alias("person")).agg(F.count("*").alias("n"))
    couples = lineage.where(F.col("father").isNotNull() & F.col("mother").isNotNull() & (F.col("father") != F.col("mother")))
    pairs = couples.withColumn("one", F.least("father", "mother")).withColumn("other", F.greatest("father", "mother"))
    childless = pairs.join(brood.select(F.col("person").alias("child"), F.lit(1).alias("has")), "child", "left")
    groups = childless.groupBy("one", "other").agg(
        F.array_sort(F.collect_list("child")).alias("children"), F.min_by(F.struct("family", "mother", "father"), "child").alias("first"), F.count("*").alias("n"), F.count("has").alias("grown")
    ).where("grown = 0")
    for who in ("one", "other"):
        own = brood.select(F.col("person").alias(who), F.col("n").alias(f"n_{who}"))
        groups = groups.join(own, who).where(F.col("n") == F.col(f"n_{who}")).join(has_parents.select(F.col("person").alias(who)), who, "left_anti")
    return groups.select("first.family", "first.mother", "first.father", "children")


def in_order(rows: DataFrame) -> DataFrame:
    """(person, layer, ord): places from 1 in an order that has parents before their children, layer by layer. Only sizes
    of layers meet in one task; within a layer, places go by ranges of a hash of the name."""
    from . import ranges

    layers = generations(checked(rows))
    before = layers.groupBy("layer").agg(F.count("*").alias("n")).select("layer", (F.sum("n").over(Window.orderBy("layer")) - F.col("n")).alias("before"))
    ranked = ranges.rank_by_position(layers.withColumn("at", F.xxhash64("person") % (1 << 20)), ["layer"], "at", ["person"])
    return ranked.join(F.broadcast(before), "layer").select("person", "layer", (F.col("before") + F.col("ord")).cast("long").alias("ord"))
