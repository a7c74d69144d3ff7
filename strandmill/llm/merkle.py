"""A Merkle manifest of a table: bottom-up build over persisted levels, proofs pushed from the root down.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group (a source) in order of their ids are hashed in
runs of `fanout`, level by level, to the group's subroot; the subroots, in order of the groups, likewise to the root.

* Numbering. Rows are dealt by ranges of (group, id, leaf), sorted within partitions and written with their partition;
  a row's place is its number in its partition plus the rows of its group in earlier ones. Only counts by (partition,
  group) meet in a window, so a group of any size is spread over all partitions.
* Levels. Runs are keyed by (group, place div fanout), hold `fanout` nodes at most, and are written to the shared
  folder: one table a level, a sixteenth of the one below. All groups rise together; a group leaves when one node
  remains.
* Proofs. From the root down, each level's table is joined by (group, place) to what the level above has handed down;
  a child prepends its siblings to the inherited suffix. At the lowest level a suffix is joined once for a run and
  opened there, so proofs of single rows are never shuffled.

All of it is DataFrame functions. The driver learns the number of levels and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written

FANOUT = 16
#: So many counts of (partition, group) are sent to every task; beyond that they are joined by a shuffle.
FEW = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with `place` (from 0, by `order` within `group`) and `n` (rows of the group), and the tables behind them.

    Equal rows take neighbouring places. Nulls come first, strings in order of their bytes.
    """
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    kept = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    by_part = kept.groupBy(F.shiftright("_at", 33).alias("_part"), F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    earlier, whole = Window.partitionBy("_group").orderBy("_part"), Window.partitionBy("_group")
    starts = by_part.select("_part", "_group", (F.sum("_rows").over(earlier) - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    starts = written(starts, f"{name}-starts")
    few = starts.count() <= FEW
    joined = kept.join(F.broadcast(starts) if few else starts, (F.shiftright("_at", 33) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).select(*rows.columns, "place", "n"), [kept, starts]


def _runs(nodes: DataFrame, fanout: int, name: str) -> DataFrame:
    """A level: runs of up to `fanout` nodes with their hash, `n` being the number of runs of the group."""
    children = F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda c: c["node"])
    runs = nodes.groupBy("g", F.expr(f"place div {fanout}").alias("run")).agg(children.alias("children"), F.expr(f"(first(n) + {fanout - 1}) div {fanout}").alias("n"))
    return written(runs.withColumn("hash", F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256)), name)


def _tree(leaves: DataFrame, most: int, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the leaves, lowest first, and the roots of the groups (g, hash).

    `leaves`: g, place, n and node, a struct that begins with the hash. `most`: the largest n.
    """
    levels, roots = [], leaves.where("n = 1").select("g", "node.hash")
    nodes = leaves.where("n > 1")
    while most > 1:
        level = _runs(nodes, fanout, f"{name}-{len(levels)}")
        levels.append(level)
        most = -(-most // fanout)
        roots = roots.unionByName(level.where("n = 1").select("g", "hash"))
        nodes = level.where("n > 1").select("g", F.col("run").alias("place"), "n", F.struct("hash").alias("node"))
    return levels, roots


#: What is handed down: the group's root, the root of all, and of each level, lowest first, the hashes to the left and
#: to the right of the node within its run.
_PROOF = "struct<subroot:string,root:string,steps:array<struct<left:string,right:string>>>"


def _proof(subroot: Column, root: Column, steps: Column) -> Column:
    return F.struct(subroot.alias("subroot"), root.alias("root"), steps.alias("steps")).cast(_PROOF)


def _siblings(fanout: int) -> Column:
    """Of the run's k-th child (columns `children`, `k`): the step that leads from it to its parent."""
    joined = lambda part: F.array_join(F.transform(part, lambda c: c["hash"]), "")
    return F.struct(joined(F.slice("children", F.lit(1), F.col("k"))).alias("left"), joined(F.slice("children", F.col("k") + 2, F.lit(fanout))).alias("right"))


def _push(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """(g, place, node, proof) of the nodes below the lowest level, from `above`: (g, proof) of the groups' roots."""
    handed = None
    for level in reversed(levels):
        runs = level.where("n = 1").join(above.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("g", "run", "children", "proof")
        if handed is not None:
            down = handed.select(F.col("g").alias("_g"), F.col("place").alias("run"), "proof")
            rest = level.where("n > 1").withColumnRenamed("run", "_run").join(down, F.col("g").eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("run")))
            runs = runs.unionByName(rest.select("g", "run", "children", "proof"))
        opened = runs.select("*", F.posexplode("children").alias("k", "node"))
        steps = F.concat(F.array(_siblings(fanout)), F.col("proof.steps"))
        handed = opened.select("g", (F.col("run") * fanout + F.col("k")).alias("place"), "node", _proof(F.col("proof.subroot"), F.col("proof.root"), steps).alias("proof"))
    return handed


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level from the leaf, each level from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, group_col: str, id_col: str, leaf: Column, also: dict[str, Column] | None = None, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """(group, id, the columns `also`, leaf, place, subroot, root, steps) of every row, and the tables of levels.

    `leaf` is a hash of the row in lowercase hex. Within a group, rows with a null id come first and rows of one id
    follow each other by leaf; repeated rows are leaves of their own. The group of a null name comes first. A group of
    one row is its own subroot, and one group alone is the root. An empty table gives no rows and no levels. Columns of
    `rows` are read by `leaf` and `also` only, whatever their names.
    """
    also = also or {}
    narrow = written(rows.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), leaf.alias("hash"), F.struct(F.lit(0).alias("none"), *(c.alias(k) for k, c in also.items())).alias("more")), "leaves")
    placed, behind = numbered(narrow, "g", ["id", "hash"], "placed")
    nodes = placed.select("g", "place", "n", F.struct("hash", "id", "more").alias("node"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = _tree(nodes, most, fanout, "level")
    subroots = written(roots, "subroots")
    alone = written(nodes.where("n = 1").select("g", "place", "node"), "alone")
    discard(narrow, *behind)

    ordered, behind = numbered(subroots.select(F.lit(0).alias("one"), F.struct("g", "hash").alias("top")), "one", ["top"], "tops")
    tops = ordered.select(F.col("one").alias("g"), "place", "n", F.struct("top.hash", "top.g").alias("node"))
    top_levels, top_roots = _tree(tops, subroots.count(), fanout, "top")
    root = top_roots.select("g", _proof(F.lit(None), F.col("hash"), F.array()).alias("proof"))
    heads = _push(top_levels, root, fanout) if top_levels else tops.join(root, "g")
    heads = written(heads.select("node.g", _proof(F.col("node.hash"), F.col("proof.root"), F.col("proof.steps")).alias("proof")), "heads")
    discard(subroots, *behind)

    proofs = alone.join(heads.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("g", "place", "node", "proof")
    if levels:
        proofs = proofs.unionByName(_push(levels, heads, fanout))
    more = [F.col(f"node.more.{k}").alias(k) for k in also]
    return proofs.select(F.col("g").alias("group"), F.col("node.id").alias("id"), *more, F.col("node.hash").alias("leaf"), "place", "proof.subroot", "proof.root", "proof.steps"), [*levels, *top_levels]


def _document(text: Column) -> Column:
    return leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of documents, checked against a copy in which the texts of some are lower-cased.

    doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. A row is tampered with where 5 divides the
    CRC-32 of its id in decimal, never where the id is null; only the letters A-Z of its text change, so a text without
    them, empty or null still leads to the root.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, _document(F.translate("text", UPPER, LOWER)))
    rows, _ = manifest(docs, "source", "doc_id", _document(F.col("text")), {"changed": changed}, fanout)
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
