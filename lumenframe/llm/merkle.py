"""Merkle manifest of a dataset: a tree of SHA-256 digests over rows in order, by group, with a proof for each row.

Each row's digest is a leaf. Within a group, leaves stand in the order of a key; while more than one node remains, every
FANOUT consecutive ones (the last run may be shorter, even one) become the digest of their digests' concatenated hex text.
What remains is the group's subroot; subroots in the order of their groups give the root likewise.

Leaves get their places by range partitions, and blocks of FANOUT ** LEVELS consecutive leaves of a group are reduced to one
node each, so that no task holds a group. Where more than TOP nodes are left, they are reduced the same way, first within
groups, then over groups. The driver builds the tree of the at most TOP nodes that are left and broadcasts each one's
siblings up to the root (its suffix path); blocks complete their rows' paths with it and fold each row back to a root.

Null groups come first, null keys first in their group. Rows of one group and key stand in the order of their leaves, so
repeated rows change nothing in their digests but their places. An empty table has no rows, no subroots and the root None.
Very long values are hashed whole. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._shared import checkpoint, join_groups, let, placed, quoted, written

FANOUT = 16
#: Levels that a block reduces: 4096 leaves of 64 hex digits are 256 kB.
LEVELS = 3
#: Most nodes that come to the driver; their paths (six levels of 15 siblings) are at most 24 MB.
TOP = 4096
PATH = "array<struct<l:string,r:string>>"


def digest(values: list[Column]) -> Column:
    """Digest of columns: each is ``-`` where null, else its length in UTF-8 bytes, a colon and its text."""

    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[told(c) for c in values]), 256)


def up(nodes: Column) -> Column:
    """The next level of an array of at least one node."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def around(nodes: Column, at: Column) -> Column:
    """The siblings of node ``at`` (from 0), concatenated: those left of it in its run, those right of it."""
    within = at % FANOUT
    return F.struct(F.array_join(F.slice(nodes, at - within + 1, within), "").alias("l"), F.array_join(F.slice(nodes, at + 2, FANOUT - 1 - within), "").alias("r"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def small_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a few nodes, and each one's path to it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    level, width = nodes, 1
    while len(level) > 1:
        for i, path in enumerate(paths):
            at = i // width
            start = at - at % FANOUT
            path.append(("".join(level[start:at]), "".join(level[at + 1 : start + FANOUT])))
        level = [sha256("".join(level[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(level), FANOUT)]
        width *= FANOUT
    return level[0], paths


def _depth(n: Column) -> Column:
    """Levels over n nodes: the least d with FANOUT ** d >= n; hexadecimal digits of n - 1, as FANOUT is 16."""
    return F.when(n <= 1, 0).otherwise(F.length(F.hex(n - 1)))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per block, written: group, block, depth (levels left to its group's subroot from these nodes), the nodes'
    rows in order, their levels l0 ..., and the block's node. nodes: _g, _pos, depth, _node and what else rows carry."""
    carried = [c for c in nodes.columns if c not in ("_g", "_pos", "depth")]
    held = nodes.groupBy("_g", F.floor(F.col("_pos") / FANOUT**levels).alias("block")).agg(F.first("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("_pos", *carried))).alias("rows"))
    held = held.withColumn("l0", F.col("rows._node"))
    for k in range(levels):
        held = held.withColumn(f"l{k + 1}", F.when(F.col("depth") > k, up(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return written(held.withColumn("node", F.element_at(f"l{levels}", 1)).drop(f"l{levels}"))


def _climb(nodes: DataFrame, levels: int, top: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Reduce nodes until at most ``top`` are left or each group has one: the blocks of each step, the nodes, their count."""
    steps: list[DataFrame] = []
    while True:
        steps.append(_blocks(nodes, levels))
        nodes = steps[-1].select("_g", F.col("block").alias("_pos"), F.greatest(F.col("depth") - levels, F.lit(0)).alias("depth"), F.col("node").alias("_node"))
        left, unfinished = nodes.agg(F.count(F.lit(1)), F.count(F.when(F.col("depth") > 0, 1))).first()
        if left <= top or not unfinished:
            return steps, nodes, left


def _with_paths(blocks: DataFrame, paths: DataFrame, known: int) -> DataFrame:
    """Blocks with their suffix paths, by broadcast where the paths' known number is at most TOP."""
    paths = paths.withColumnRenamed("_pos", "block")
    return blocks.join(F.broadcast(paths) if known <= TOP else paths, ["_g", "block"])


def _path(row: Column, i: Column, depth: Column, levels: int) -> Column:
    """Path of row i of a block: within the block, then the block's own."""
    within = [F.when(depth > k, F.array(around(F.col(f"l{k}"), F.shiftright(i, 4 * k)))).otherwise(F.array().cast(PATH)) for k in range(levels)]
    return F.concat(*within, F.col("path"))


def _descend(steps: list[DataFrame], paths: DataFrame, known: int, levels: int) -> tuple[DataFrame, int]:
    """Paths of the first step's blocks from those of the last step's. paths: _g, _pos, path, and columns passed on."""
    for blocks in reversed(steps[1:]):
        more = [c for c in paths.columns if c not in ("_g", "_pos", "path")]
        each = F.transform("rows", lambda r, i: F.struct(r["_pos"].alias("_pos"), _path(r, i, F.col("depth"), levels).alias("path")))
        below = _with_paths(blocks, paths, known).select("_g", *more, F.explode(each).alias("e"))
        paths = written(below.select("_g", "e._pos", "e.path", *more))
        known = paths.count()
    return paths, known


@dataclass
class Tree:
    """A built tree: blocks of leaves, the paths of those blocks with their subroots, and the root."""

    blocks: DataFrame
    paths: DataFrame
    known: int
    root: str | None
    key: str
    levels: int

    def subroots(self) -> DataFrame:
        """The manifest: group, number of rows and subroot of each group, by group."""
        found = _with_paths(self.blocks, self.paths, self.known).groupBy("_g").agg(F.sum(F.size("rows")).alias("n_rows"), F.first("subroot").alias("subroot"))
        return found.select(_group_of(F.col("_g")).alias("group"), "n_rows", "subroot")

    def rows(self, claimed: bool = False, paths: bool = False) -> DataFrame:
        """Each leaf with its subroot, the root, the digest of its proof and the root that it folds back to.

        claimed: leaves carry another leaf (null: their own) in ``claimed``, which is folded in their place, to test whether
        it is the row that the tree was built of. paths: with the siblings themselves, as (l, r) a level.
        """
        leaf = lambda r: F.coalesce(r["claimed"], r["_node"]) if claimed else r["_node"]

        def told(r: Column, i: Column) -> Column:
            def with_path(path: Column) -> Column:
                out = [r["_key"].alias("_key"), r["_node"].alias("leaf"), proof_digest(path).alias("proof_sha256"), folded(leaf(r), path).alias("folded_root")]
                return F.struct(*out, *([path.alias("path")] if paths else []))

            return let(_path(r, i, F.col("depth"), self.levels), with_path)

        each = _with_paths(self.blocks, self.paths, self.known).select("_g", "subroot", F.explode(F.transform("rows", told)).alias("e"))
        out = each.select(F.col("e._key").alias(self.key), _group_of(F.col("_g")).alias("group"), "e.leaf", "subroot", F.lit(self.root).alias("root"), "e.proof_sha256", "e.folded_root", *(["e.path"] if paths else []))
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _group_of(g: Column) -> Column:
    return F.when(g != "", F.substr(g, F.lit(2)))


def build(leaves: DataFrame, key: str, group: str, leaf: str = "leaf", claimed: str | None = None, levels: int = LEVELS, top: int = TOP) -> Tree:
    """The tree over a table of leaves: a group (string), a key to order by, a digest, and perhaps a claimed digest to fold."""
    spark = leaves.sparkSession
    # Null groups come first: '' before 's' and the group's name.
    named = leaves.select(F.coalesce(F.concat(F.lit("s"), quoted(group)), F.lit("")).alias("_g"), quoted(key).alias("_key"), quoted(leaf).alias("_node"), *([quoted(claimed).alias("claimed")] if claimed else []))
    named = written(named)
    depths = checkpoint(named.groupBy("_g").agg(_depth(F.count(F.lit(1))).alias("depth")))
    nodes = join_groups(placed(named, "_g", ["_key", "_node"]), depths, ["_g"])
    steps, ends, left = _climb(nodes, levels, top)
    root = None
    if left <= top:
        by_group: dict[str, list[tuple[int, str]]] = {}
        for r in ends.collect():
            by_group.setdefault(r["_g"], []).append((r["_pos"], r["_node"]))
        groups, out = sorted(by_group, key=str.encode), []
        trees = [small_tree([node for _, node in sorted(by_group[g])]) for g in groups]
        if groups:
            root, above = small_tree([subroot for subroot, _ in trees])
            for g, (subroot, within), over in zip(groups, trees, above, strict=True):
                out += [(g, pos, path + over, subroot) for (pos, _), path in zip(sorted(by_group[g]), within, strict=True)]
        paths = spark.createDataFrame(out, f"_g string, _pos long, path {PATH}, subroot string")
    else:  # one node a group, and more groups than the driver takes: their subroots are a group of their own
        order = written(placed(ends.select("_g", "_node"), None, ["_g"]))
        over, tops, left = _climb(order.select(F.lit("").alias("_g"), "_pos", _depth(F.lit(left)).alias("depth"), "_node"), levels, top)
        found = sorted((r["_pos"], r["_node"]) for r in tops.collect())
        root, above = small_tree([node for _, node in found])
        paths = spark.createDataFrame([("", pos, path) for (pos, _), path in zip(found, above, strict=True)], f"_g string, _pos long, path {PATH}")
        # Each group is a node of the first step over groups: its path starts within that step's blocks.
        paths, left = _descend(over, paths, left, levels)
        each = F.transform("rows", lambda r, i: F.struct(r["_pos"].alias("_pos"), _path(r, i, F.col("depth"), levels).alias("path")))
        below = _with_paths(over[0], paths, left).select(F.explode(each).alias("e")).select("e._pos", "e.path")
        paths = written(order.join(below, "_pos").select("_g", F.lit(0).cast("long").alias("_pos"), "path", F.col("_node").alias("subroot")))
        left = paths.count()
    paths, left = _descend(steps, paths, left, levels)
    return Tree(steps[0], paths, left, root, key, levels)
