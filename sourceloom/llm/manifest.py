"""Merkle manifest of a table: a hash tree per group of rows, and one over the groups.

A row's place in its group is written in digits of base ``ARITY``. One shuffle brings the
rows of a block, ``ARITY ** DIGITS`` consecutive ones, together; then one digit after the
other is grouped away, and each step nests the child structs and hashes them. A block ends
as one row with its whole subtree, of bounded size however large its group is. The hashes
of the blocks are the rows of the next tier, until a group has one block left. Proofs come
out of the nested structs by ``transform`` and ``explode``: rows are never joined with
hashes of their tree. Only block rows (one for 2,187 rows of the table) fetch what lies
above them from the tier above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.shared import kept
from sourceloom.operators.skew import SkewPolicy, with_rank

ARITY = 3
DIGITS = 7
BLOCK = ARITY**DIGITS
# Groups with more rows are ranked in several tasks.
RANGES = SkewPolicy(max_rows=16_384)
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def nested(ranked: DataFrame) -> DataFrame:
    """``key, block, node`` from rows ``key, at, node``: one row per block, its root with
    all below. ``at`` counts from 0; a node is a struct that has a ``hash``."""
    digit = lambda k: F.pmod(F.call_function("div", F.col("at"), F.lit(ARITY**k)), F.lit(ARITY)).cast("int")
    rows = ranked.select(
        "key", F.call_function("div", F.col("at"), F.lit(BLOCK)).alias("block"), *(digit(k).alias(f"d{k}") for k in range(DIGITS)), "node"
    ).repartition("key", "block")
    for k in range(DIGITS):
        above = [f"d{j}" for j in range(k + 1, DIGITS)]
        run = F.array_sort(F.collect_list(F.struct(f"d{k}", "node")))
        rows = rows.groupBy("key", "block", *above).agg(run["node"].alias("children"))
        # A run of one that starts the group is all that remains of it: nothing is hashed.
        root = F.size("children") == 1
        for name in ("block", *above):
            root &= F.col(name) == 0
        below = F.sha2(F.array_join(F.col("children")["hash"], ""), 256)
        node = F.struct(F.when(root, F.col("children")[0]["hash"]).otherwise(below).alias("hash"), (~root).alias("hashed"), "children")
        rows = rows.select("key", "block", *above, node.alias("node"))
    return rows


def tiers(ranked: DataFrame) -> list[DataFrame]:
    """Block rows over the rows, over those blocks, and so on, until each key has one block."""
    out = [kept(nested(ranked))]
    while out[-1].agg(F.max("block")).first()[0]:
        blocks = out[-1].select("key", F.col("block").alias("at"), F.struct(F.col("node.hash").alias("hash"), "block").alias("node"))
        out.append(kept(nested(blocks)))
    return out


def leaves_below(node: Column, path: Column, levels: int = DIGITS) -> Column:
    """Array of ``node, path`` for all leaves; a path has for each level, from the leaf up,
    the hashes left and right of it in its run, as texts in a row."""
    children = node["children"]

    def one(child: Column, i: Column) -> Column:
        left = F.array_join(F.slice(children, F.lit(1), i)["hash"], "")
        right = F.array_join(F.slice(children, i + 2, F.lit(ARITY))["hash"], "")
        step = F.struct(left.alias("left"), right.alias("right"))
        longer = F.when(node["hashed"], F.concat(F.array(step), path)).otherwise(path)
        if levels == 1:
            return F.array(F.struct(child.alias("node"), longer.cast(PATH).alias("path")))
        return leaves_below(child, longer, levels - 1)

    return F.flatten(F.transform(children, one))


def opened(forest: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``key, node, path`` and the other columns of ``tops`` (``key, path, ...``, a row per
    key: the path above its root) for every leaf of a forest's trees."""
    above = tops.withColumn("block", F.lit(0).cast("bigint"))
    carried = [c for c in tops.columns if c not in ("key", "path")]
    for level, blocks in enumerate(reversed(forest)):
        found = blocks.join(above, ["key", "block"]).select("key", *carried, F.explode(leaves_below(F.col("node"), F.col("path"))).alias("leaf"))
        if level == len(forest) - 1:
            return found.select("key", *carried, "leaf.node", "leaf.path")
        above = found.select("key", *carried, F.col("leaf.path").alias("path"), F.col("leaf.node.block").alias("block"))


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column]) -> DataFrame:
    """A tree of hashes per value of ``group`` over rows in ascending ``order``, and one over
    the groups in bytewise order of their names, null first.

    One row per input row: the ``carry`` columns (one at least), ``leaf`` (the hash of ``columns``),
    ``subroot``, ``root`` (hex texts) and ``path`` (see ``folded``). Every ``ARITY`` consecutive
    nodes (at the end fewer) become the hash of their hashes in a row, while more than one
    remains. Rows with a null ``order`` come first; rows that tie come in ascending order of
    their leaves, so repeated rows change no result but have a leaf each. Null and empty
    fields differ. A text of any length is read once, by the hash of its row. Columns not
    named are ignored, whatever their names. An empty table gives no rows.
    """
    name = lambda c: F.col(f"`{c}`")
    # A text that sorts as the group does, and is never null.
    key = F.coalesce(F.concat(F.lit("="), name(group).cast("string")), F.lit("")).alias("key")
    hashed = leaf_hash(*(name(c) for c in columns)).alias("hash")
    leaves = docs.select(key, name(order).alias("first"), hashed, F.monotonically_increasing_id().alias("tie"), F.struct(*(v.alias(n) for n, v in carry.items())).alias("row"))
    ranked = with_rank(leaves, ["key"], ["first", "hash", "tie"], sized=docs.select(key), policy=RANGES)
    trees = tiers(ranked.select("key", (F.col("rank") - 1).alias("at"), F.struct("hash", "row").alias("node")))
    roots = trees[-1].select("key", F.col("node.hash").alias("hash"))
    ranked = with_rank(roots, [], ["key"], policy=RANGES)
    upper = tiers(ranked.select(F.lit("").alias("key"), (F.col("rank") - 1).alias("at"), F.struct("hash", F.col("key").alias("group")).alias("node")))
    top = upper[-1].select("key", F.col("node.hash").alias("root"), F.array().cast(PATH).alias("path"))
    groups = opened(upper, top).select(F.col("node.group").alias("key"), "path", F.col("node.hash").alias("subroot"), "root")
    return opened(trees, groups).select("node.row.*", F.col("node.hash").alias("leaf"), "subroot", "root", "path")


def proof_text(path: Column) -> Column:
    """All hashes of a path in a row: level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
