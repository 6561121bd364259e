"""A Merkle manifest of a table: a digest per row, a tree per group, one root, and a proof for every row.

Trees are built by slot pivots: the children of a parent stand side by side in as many columns as the fan-out. All
columns joined and hashed are the parent; all but its own are a child's siblings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import BLOCK, PLACE, in_order
from ..session import stored

FANOUT = 8
#: Levels that a count of rows in 64 bits can need.
_DEEPEST = 21


def digest(columns: list[Column]) -> Column:
    """SHA-256 in lower-case hex over the values: ``-`` for NULL, else bytes in UTF-8, a colon and the value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def _named(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in df.columns])


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Rows (g, d, p, node): depth of the group's tree and position in it; and the greatest depth.

    One range sort. A row's position follows from its place in the block, the first place of its group there and the
    group's rows in earlier blocks: a table of one row per block and group, so that a large group is not a large task.
    """
    placed = in_order(leaves, ["g"], ["k", "digest"])
    group = Window.partitionBy("g")
    blocks = stored(placed.groupBy("g", BLOCK).agg(F.min(PLACE).alias("start"), F.count("*").alias("rows"))
                    .select(F.col("g").alias("_g"), F.col(BLOCK).alias(f"_{BLOCK}"), "start",
                            (F.sum("rows").over(group.orderBy(BLOCK)) - F.col("rows")).alias("before"),
                            F.sum("rows").over(group).alias("n")), "manifest_blocks")
    most = blocks.agg(F.max("n")).first()[0] or 0
    depth = sum(((F.col("n") > FANOUT ** i).cast("int") for i in range(_DEEPEST)), F.lit(0))
    rows = placed.join(blocks, _same(placed, blocks, "g", BLOCK)).select(
        "g", depth.alias("d"), (F.col(PLACE) - F.col("start") + F.col("before")).alias("p"),
        F.struct("digest", "item").alias("node"))
    return rows, sum(most > FANOUT ** i for i in range(_DEEPEST))


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: (g, d, p, s_0 to s_7, node); each run of children lies in the slot columns of its parent."""
    slot = F.col("p") % FANOUT
    names = [f"s_{i}" for i in range(FANOUT)]
    wide = nodes.groupBy("g", "d", F.floor(F.col("p") / FANOUT).alias("p")).agg(
        *[F.max(F.when(slot == i, F.col("node"))).alias(s) for i, s in enumerate(names)])
    return wide.withColumn("node", F.struct(F.sha2(F.concat_ws("", *[F.col(s)["digest"] for s in names]), 256).alias("digest")))


def _children(parents: DataFrame, above: DataFrame) -> DataFrame:
    """One level down: every filled slot with its siblings put before the parent's path."""
    names = [f"s_{i}" for i in range(FANOUT)]
    digests = [F.col(s)["digest"] for s in names]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).alias("node"), F.concat_ws("", *digests[:i]).alias("left"),
                               F.concat_ws("", *digests[i + 1:]).alias("right")) for i, s in enumerate(names)])
    right = _named(above, "g", "p")
    return (parents.select("g", "p", slots.alias("slots")).join(right, _same(parents, right, "g", "p"))
            .select("g", "p", "path", "subroot", "root", F.explode(F.filter("slots", lambda s: s["node"].isNotNull())).alias("c"))
            .select("g", (F.col("p") * FANOUT + F.col("c.slot")).alias("p"), F.col("c.node").alias("node"),
                    F.concat(F.array(F.struct("c.left", "c.right")), F.col("path")).alias("path"), "subroot", "root"))


def prove(leaves: DataFrame, single: bool = False) -> DataFrame:
    """Paths of leaves (g, k, digest, item): group, order in it, digest, and what else to carry.

    Per group, leaves ascend by ``k`` (NULL first), equal ones by digest. While a group has several nodes, every
    eight in a row become one; what remains is its subroot. Subroots in the order of ``g`` (NULL first) become the
    root in the same way, unless the groups are one (``single``). Returns (node, path, subroot, root); ``node`` holds
    digest and item. Levels shrink by the fan-out and are tables; nothing but the number of levels meets the driver.
    """
    nodes, depth = _numbered(leaves)
    levels = [nodes]
    for level in range(depth):
        levels.append(stored(_parents(levels[-1].filter(F.col("d") > level)), "manifest_level"))
    tops = [t.filter(F.col("d") == i).select("g", "d", F.col("node.digest").alias("digest")) for i, t in enumerate(levels)]
    groups = reduce(DataFrame.union, tops)
    if single:
        above = groups.select("g", "d", F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                              F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        listed = stored(groups, "manifest_subroots")
        upper = prove(listed.select(F.lit(0).alias("g"), F.col("g").alias("k"), "digest", F.struct("g", "d").alias("item")), single=True)
        above = stored(upper.select("node.item.*", "path", F.col("node.digest").alias("subroot"), "root"), "manifest_groups")
    found = above.filter(F.col("d") == depth).withColumn("p", F.lit(0).cast("long")).drop("d")
    for level in range(depth, 0, -1):
        below = _children(levels[level], found)
        lone = above.filter(F.col("d") == level - 1).withColumn("p", F.lit(0).cast("long")).drop("d")
        found = below.drop("node").unionByName(lone) if level > 1 else below
    rest = _named(above.filter(F.col("d") == 0).drop("d"), "g")
    lone = nodes.filter(F.col("d") == 0).select("g", "node")
    ends = lone.join(rest, _same(lone, rest, "g")).select("node", "path", "subroot", "root")
    return found.select("node", "path", "subroot", "root").union(ends) if depth else ends


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang",
             columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: Column | None = None) -> DataFrame:
    """One row per row of the table: (k, leaf, claimed, path, subroot, root).

    ``leaf`` is the digest of the listed columns. ``path`` lists, from the leaf up, the siblings to its ``left`` and
    ``right`` as joined hex digests. ``claimed`` is a digest to hold against the manifest, such as that of a copy, else
    NULL. Rows may repeat: equal keys are ordered by digest, equal rows are leaves of their own. NULL in a listed
    column has its own mark; a NULL key stands first, a NULL group is a group. Empty texts differ from NULL. An
    empty table gives no rows and has no root. Other columns, whatever their names, are not read.
    """
    kept = F.lit(None).cast("string") if claimed is None else claimed
    leaves = docs.select(F.col(group).alias("g"), F.col(key).alias("k"), digest([F.col(c) for c in columns]).alias("digest"),
                         F.struct(F.col(key).alias("k"), kept.alias("claimed")).alias("item"))
    return prove(stored(leaves, "manifest_leaves")).select(
        F.col("node.item.k").alias("k"), F.col("node.digest").alias("leaf"), F.col("node.item.claimed").alias("claimed"),
        "path", "subroot", "root")
